"""Print the registered keys of the named areas."""
import importlib
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from docketry.checks import AREAS, base  # noqa: E402

for area in AREAS:
    before = set(base.QUERIES)
    importlib.import_module(f"docketry.checks.{area}")
    if area in sys.argv[1:]:
        print(*[k for k in base.QUERIES if k not in before])

"""Every registered query, by area."""

from __future__ import annotations

import importlib

AREAS = ["policies", "texts", "access", "reporting", "retrieval", "layout", "fields", "streams"]


def load_all() -> tuple[dict, dict]:
    """(queries, oracle SQL) of all areas."""
    for area in AREAS:
        importlib.import_module(f"docketry.checks.{area}")
    from docketry.checks.base import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)

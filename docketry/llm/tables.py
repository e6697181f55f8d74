"""What the operators of this subpackage share: reading tables, ids of rows, writing once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docketry.session import settle, shared_folder
from docketry.sources.tables import read_table

__all__ = ["read_table", "settle", "scratch"]


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder of the session."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether `df` has at most so many rows; looks no further than that."""
    return df.limit(rows + 1).count() <= rows

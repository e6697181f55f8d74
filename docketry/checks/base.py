"""Registry of runnable queries and the DuckDB SQL they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.session import UNION_PARTITIONING, settle, settle_by
from docketry.sources.bindings import bind, binding_sql
from docketry.sources.tables import read_table, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COMMON: dict[str, str] = {}


class Data:
    """The given tables and the domain tables of one folder, loaded when named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.stored: dict[str, DataFrame] = {}
        spark.conf.set(*UNION_PARTITIONING)

    def once(self, name: str, make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        """A table that several steps of one query read, written once, in buckets of `by` if that is given."""
        if name not in self.stored:
            self.stored[name] = settle_by(make(), by) if by else settle(make())
        return self.stored[name]

    def table(self, name: str) -> DataFrame:
        df = read_table(self.spark, self.folder, name)
        return spread(df, "doc_id") if name == "documents" else df

    def __getattr__(self, name: str) -> DataFrame:
        return bind(self.spark, self.folder, name)


def common(name: str, sql: str) -> None:
    """A DuckDB query that oracles may name like a table."""
    COMMON[name] = sql


def with_tables(sql: str) -> str:
    """Put the domain tables and common queries a text names in front of it, in order."""
    needed: list[tuple[str, str]] = []

    def add(text: str) -> None:
        for name in re.findall(r"\b(?:from|join)\s+([a-z_0-9]+)", text):
            if any(name == n for n, _ in needed):
                continue
            body = COMMON.get(name)
            if body is None:
                from docketry.sources.bindings import TEXTS
                if name not in TEXTS:
                    continue
                body = binding_sql(name, "duckdb")
            add(body)
            needed.append((name, body))

    add(sql)
    if not needed:
        return sql
    front = ", ".join(f"{n} as materialized ({b})" for n, b in needed)
    stripped = sql.lstrip()
    if stripped.lower().startswith("with "):
        return f"with {front}, {stripped[5:]}"
    return f"with {front} {stripped}"


def query(name: str, sql: str | None = None):
    """Register a query under its key, with its SQL where there is one."""
    def register(fn: Callable[[Data], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Data(spark, folder))
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn

    return register

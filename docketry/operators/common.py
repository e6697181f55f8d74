"""Building blocks shared by several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, keys: list[str], order: str, amount: str, block: int = 4096) -> DataFrame:
    """df with `before`: the sum of `amount` over the rows of the same keys that come earlier.

    `order` is a whole number, unique per key. Rows are summed per block of `order`
    first, so one key with very many rows is worked on in blocks and no task ever
    sorts more than a block of it.
    """
    cut = df.withColumn("block", F.floor(F.col(order) / block))
    upto = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        cut.groupBy(*keys, "block").agg(F.sum(amount).alias("total"))
        .withColumn("earlier", F.coalesce(F.sum("total").over(upto), F.lit(0))).drop("total")
    )
    inside = (
        Window.partitionBy(*keys, "block").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        cut.join(blocks, [*keys, "block"])
        .withColumn("before", F.col("earlier") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .drop("block", "earlier")
    )


def top_per(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first `n` rows per key with their rank.

    Spark cuts each key to n rows before the shuffle, so a key with very many rows
    sends at most n of them per task.
    """
    over = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(over)).filter(F.col(rank) <= n)


def carry_forward(df: DataFrame, keys: list[str], order: str, value: str, block: int = 4096) -> DataFrame:
    """df with NULLs of `value` filled by the last known one before them, in blocks of `order`."""
    cut = df.withColumn("block", F.floor(F.col(order) / block))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col(value).isNotNull(), F.col(order))
    blocks = (
        cut.groupBy(*keys, "block").agg(F.max_by(value, known).alias("last_known"))
        .withColumn("carried", F.last("last_known", ignorenulls=True).over(earlier)).drop("last_known")
    )
    inside = (
        Window.partitionBy(*keys, "block").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        cut.join(blocks, [*keys, "block"])
        .withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(inside), "carried"))
        .drop("block", "carried")
    )

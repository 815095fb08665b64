"""Which of several rows with one key wins; one shuffle on the key each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.session import durable


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in ``order`` (which must be total). Rows are ranked before the shuffle too, so a hot key sends one row a task."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def keyed(df: DataFrame, key: str, order: str, keep: str = "first") -> DataFrame:
    """One row per key, the first or last in ``order``; rows with a null or empty key all stay."""
    own = F.when(F.coalesce(F.col(key), F.lit("")) == "", F.concat(F.lit("\x00"), F.col(order).cast("string"))).otherwise(F.col(key))
    return first_wins(df.withColumn("_key", own), ["_key"], [F.desc(order) if keep == "last" else F.asc(order)]).drop("_key")


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key by aggregation: map-side combined, for keys that may be hot."""

    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")


def mark_duplicates(df: DataFrame, key: str, reasons: str, order: str) -> DataFrame:
    """Adds ``duplicate_conversation`` to the reasons of every row without reasons whose key an earlier such row has.

    ``order`` is unique. The first row of each key is found by aggregation, and rows
    meet it by their own place, so the copies of one key never come together.
    """
    rows = durable(df)
    first = rows.where(F.size(reasons) == 0).groupBy(key).agg(F.min(order).alias(order)).select(order, F.lit(True).alias("_first"))
    again = (F.size(reasons) == 0) & F.col("_first").isNull()
    return rows.join(first, order, "left").withColumn(reasons, F.when(again, F.array(F.lit("duplicate_conversation"))).otherwise(F.col(reasons))).drop("_first")

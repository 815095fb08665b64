"""Running sums and extremes within groups of any size: of parts first, then inside a part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.session import durable


def running_offsets(df: DataFrame, by: list[str], order: Column, value: str, *, tie: str, bits: int = 10) -> DataFrame:
    """``df`` with ``offset``: the sum of ``value`` over the rows of the group that stand before.

    ``order`` is a 64-bit hash that puts the rows of a group in order, ``tie`` a
    unique column for equal ones; groups must not be null. A group is cut into
    ``2 ** bits`` parts by the leading bits of the order, so no task sorts a
    whole group; the sums of the parts are one row each.
    """
    ordered = df.withColumn("_order", order).withColumn("_part", F.shiftrightunsigned("_order", 64 - bits))
    parts = ordered.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_part").orderBy(F.shiftleft("_order", bits).bitwiseXOR(F.lit(-(1 << 63))), tie).rowsBetween(Window.unboundedPreceding, -1)
    out = ordered.join(parts, [*by, "_part"]).withColumn("offset", F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.drop("_order", "_part", "_before")


def in_parts(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """``df`` written in parts (``_part``) that follow each other in the order of ``by`` and ``order``; equal ones share a part."""
    return durable(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))


def over_parts(placed: DataFrame, by: list[str], order: list, value: str, combine) -> DataFrame:
    """``placed`` (see :func:`in_parts`) with ``_inside`` and ``_before``: ``combine`` of ``value`` over the earlier rows of the group in the row's part, and in all parts before it (null over none).

    One row a part and group is brought together, so no task sees a group.
    """
    totals = placed.groupBy(*by, "_part").agg(combine(value).alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_by{i}" for i in range(len(by))]
    totals = totals.select("_part", *[F.col(c).alias(n) for c, n in zip(by, names)], combine("_total").over(earlier).alias("_before")).withColumnRenamed("_part", "_of")
    same = F.col("_part") == F.col("_of")
    for c, n in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(totals, same).drop("_of", *names).withColumn("_inside", combine(value).over(inside))


def ordered_offsets(df: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    """``df`` with ``offset``: the sum of ``value`` over the rows of the group before this one in ``order``, which should be total."""
    placed = over_parts(in_parts(df, by, order), by, order, value, F.sum)
    zero = F.lit(0)
    return placed.withColumn("offset", F.coalesce("_before", zero) + F.coalesce("_inside", zero)).drop("_part", "_before", "_inside")

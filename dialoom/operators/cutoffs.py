"""Exact cumulative positions and cutoffs per group, without one task holding a group.

A group is never sorted whole. Its values are counted in bins, the bin that
holds the wanted position is found, and only that bin is looked at more finely;
equal values are counted together before the last step. A task thus sees at most
``2 ** bits`` bins of a group, and of one bin of the last level only the
distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bin(value: str, bits: int) -> Column:
    return F.least(F.floor(F.col(value) * float(1 << bits)), F.lit((1 << bits) - 1)).cast("long")


def group_cutoffs(df: DataFrame, by: list[str], value: str, k: Column, *, bits: int = 12, levels: int = 2, small_groups: bool = False) -> DataFrame:
    """The highest value of each group that at least ``k`` of its rows reach.

    ``by`` columns must not be null; ``value`` is a double in 0..1. ``k`` is an
    expression over ``by`` and ``n`` (the rows of the group). ``small_groups``
    says that the number of groups has been checked to be small, so that one row
    a group may be broadcast. Returns ``by``, ``n``, ``k``, ``cutoff``,
    ``n_above`` (rows over the cutoff) and ``n_kept`` (rows at or over it).
    Groups with ``k`` <= 0 have no row.
    """
    data = df.select(*by, value)
    groups = Window.partitionBy(*by)
    critical: DataFrame | None = None
    carried: list[str] = []
    for level in range(1, levels + 1):
        part = data.withColumn("_bin", _bin(value, bits * level))
        if critical is not None:
            side = F.broadcast(critical) if small_groups else critical
            part = part.withColumn("_outer", F.shiftright("_bin", bits)).join(side, [*by, "_outer"])
        hist = part.groupBy(*by, *carried, "_bin").agg(F.count(F.lit(1)).alias("_rows"))
        if critical is None:
            hist = hist.withColumn("n", F.sum("_rows").over(groups)).withColumn("k", k.cast("long")).withColumn("_above", F.lit(0).cast("long"))
            carried = ["n", "k", "_above"]
        hist = hist.withColumn("_upto", F.col("_above") + F.sum("_rows").over(groups.orderBy(F.desc("_bin"))))
        critical = hist.where((F.col("k") > 0) & (F.col("_upto") >= F.col("k")) & (F.col("_upto") - F.col("_rows") < F.col("k"))).select(
            *by, "n", "k", (F.col("_upto") - F.col("_rows")).alias("_above"), F.col("_bin").alias("_outer")
        )
    side = F.broadcast(critical) if small_groups else critical
    last = data.withColumn("_outer", _bin(value, bits * levels)).join(side, [*by, "_outer"]).groupBy(*by, *carried, value).agg(F.count(F.lit(1)).alias("_rows"))
    last = last.withColumn("n_kept", F.col("_above") + F.sum("_rows").over(groups.orderBy(F.desc(value))))
    return last.where((F.col("n_kept") >= F.col("k")) & (F.col("n_kept") - F.col("_rows") < F.col("k"))).select(
        *by, "n", "k", F.col(value).alias("cutoff"), (F.col("n_kept") - F.col("_rows")).alias("n_above"), "n_kept"
    )

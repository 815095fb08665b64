"""Joins that survive hot keys, and completeness checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoom.session import durable


def salted_join(big: DataFrame, small: DataFrame, on: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join in which a hot key of ``big`` is spread over ``salts`` tasks; the rows of ``small`` are copied that often."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the copied side cannot be kept whole")
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in big.columns if c != on] or [on]), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [on, "_salt"], how).drop("_salt")


def completeness(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``key, state`` with missing, unexpected or repeated for every key that does not meet exactly one row."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(1))
    f = found.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_n") > 1, "repeated")
    return e.join(f, key, "full").withColumn("state", state).where("state is not null").select(key, "state")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``_i``, the place of each row from 0; places are counted per part, so nothing is brought together."""
    rows = durable(df.withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftrightunsigned("_at", 33))
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a part
    return rows.join(parts.select("_part", before.alias("_before")), "_part").withColumn("_i", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_before")


def positional(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two frames joined by their place; an error if the lengths differ."""
    if a.count() != b.count():
        raise ValueError("the frames differ in length")
    right = numbered(b)
    return numbered(a).join(right.select("_i", *[F.col(c).alias(f"right_{c}") for c in b.columns]), "_i").drop("_i")

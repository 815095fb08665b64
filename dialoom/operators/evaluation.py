"""Evaluation statistics: rubric scores, agreement, worst-at-k, win rates, pass@k, bootstrap."""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import text as T
from dialoom.operators.prefix import in_parts, ordered_offsets, over_parts


def rubric_score(points: Column, met: Column) -> Column:
    """Aggregate: points of the met items over all positive points; null where there are none."""
    return F.sum(F.when(met, points).otherwise(0.0)) / F.nullif(F.sum(F.when(points > 0, points)), F.lit(0.0))


def clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def pairwise_agreement(labels: DataFrame, item: str, rater: str, label: str, by: list[str] | None = None, alone: str | None = None) -> DataFrame:
    """Each rater against every other rater of the item: precision by own label, recall by the other's.

    Returns ``by..., metric, positive, n, value``. Per item only the numbers of
    raters with each label matter, so no pair is built: a rater with label x
    meets (raters with x) - 1 that agree. ``alone`` keeps one row per value of
    that column too, for per-rater results.
    """
    by = by or []
    counts = labels.groupBy(*by, item).agg(F.count_if(F.col(label)).alias("_p"), F.count_if(~F.col(label)).alias("_n"))
    agg = lambda good, n: (F.sum(n).alias("n"), (F.sum(good) / F.sum(n)).alias("value"))
    both, p, n = F.col("_p") + F.col("_n"), F.col("_p"), F.col("_n")
    # ordered pairs with own label positive: p * (both - 1), of which p * (p - 1) agree; recall groups by the other's label and is symmetric
    if alone:
        rows = labels.join(counts, [*by, item])
        same = F.when(F.col(label), p).otherwise(n) - 1
        own = rows.groupBy(*by, alone, F.col(label).alias("positive")).agg(*agg(same, both - 1))
        other = rows.select(*by, alone, F.explode(F.array(F.struct(F.lit(True).alias("positive"), (p - F.col(label).cast("int")).alias("k"), F.col(label).alias("ok")), F.struct(F.lit(False).alias("positive"), (n - (~F.col(label)).cast("int")).alias("k"), (~F.col(label)).alias("ok")))).alias("x"))
        other = other.groupBy(*by, alone, F.col("x.positive").alias("positive")).agg(F.sum("x.k").alias("n"), (F.sum(F.when(F.col("x.ok"), F.col("x.k")).otherwise(0)) / F.nullif(F.sum("x.k"), F.lit(0))).alias("value"))
        keys = [*by, alone]
    else:
        rows = counts.select(*by, F.explode(F.array(F.struct(F.lit(True).alias("positive"), (p * (p - 1)).alias("good"), (p * (both - 1)).alias("n")), F.struct(F.lit(False).alias("positive"), (n * (n - 1)).alias("good"), (n * (both - 1)).alias("n")))).alias("x"))
        own = rows.groupBy(*by, F.col("x.positive").alias("positive")).agg(*agg(F.col("x.good"), F.col("x.n")))
        other, keys = own, by
    tag = lambda df, name: df.where("n > 0").select(*keys, F.lit(name).alias("metric"), "positive", "n", "value")
    return tag(own, "precision").unionByName(tag(other, "recall"))


def f1_and_balanced(pr: DataFrame, by: list[str]) -> DataFrame:
    """F1 per class from precision and recall (0 if both are), and the mean of the two classes as ``balanced``."""
    wide = pr.groupBy(*by, "positive").pivot("metric", ["precision", "recall"]).agg(F.first("value"))
    f1 = wide.where("precision is not null and recall is not null").withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
    both = f1.groupBy(*by).agg(F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("_k")).where("_k = 2").select(*by, F.lit(None).cast("boolean").alias("positive"), F.col("f1"))
    return f1.select(*by, "positive", "f1").unionByName(both)


def worst_at_k(df: DataFrame, by: list[str], item: str, score: str, most: int) -> DataFrame:
    """``by, k, value``: mean over items of the expected minimum of k of the item's scores, k up to ``most``.

    The minimum over all k-subsets has a closed form over the sorted scores, so
    no subset is listed. Items with fewer than k scores do not count for that k.
    """
    w = Window.partitionBy(*by, item)
    ranked = df.where(F.col(score).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(score))).withColumn("_n", F.count(F.lit(1)).over(w))
    rows = ranked.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(most)).cast("int"))))
    # C(n - i, k - 1) / C(n, k) as a product of k factors
    ratio = F.aggregate(F.sequence(F.lit(0), F.col("k") - 1), F.lit(1.0), lambda acc, j: acc * F.when(j == F.col("k") - 1, F.col("k") / (F.col("_n") - j)).otherwise((F.col("_n") - F.col("_i") - j) / (F.col("_n") - j).cast("double")))
    per = rows.groupBy(*by, item, "k").agg(F.sum(F.col(score) * F.greatest(ratio, F.lit(0.0))).alias("_v"))
    return per.groupBy(*by, "k").agg(F.avg("_v").alias("value"))


def pass_at_k(n: Column, correct: Column, k: int) -> Column:
    """Unbiased chance that one of k of n samples is correct, as a product (no large binomials)."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, j: acc * (n - correct - j) / (n - j).cast("double"))
    return F.when(n - correct < k, F.lit(1.0)).otherwise(1.0 - miss)


def win_rates(df: DataFrame, model: str, item: str, score: str, size: str | None = None, within: float = 0.1) -> DataFrame:
    """``model, other, value``: mean over items of the share of row pairs that ``model`` wins.

    Ties and null scores are skipped; with ``size``, so are pairs whose lengths
    differ by more than ``within`` of their mean, or are both zero. Equal rows are
    counted first; then each item counts the smaller scores of the other models by
    sorting, so no pair of rows is built. An item's distinct rows are in one task.
    """
    keys = [F.col(item).alias("_item"), F.col(model).cast("string").alias("model"), F.col(score).cast("double").alias("_score"), (F.col(size) if size else F.lit(1)).cast("double").alias("_size")]
    cells = df.where(F.col(score).isNotNull()).select(*keys).where("_item is not null and _size is not null").groupBy("_item", "model", "_score", "_size").agg(F.count(F.lit(1)).alias("_c"))

    def shares(rows):
        own = {m: tuple(x[c].to_numpy() for c in ("_score", "_size", "_c")) for m, x in rows.groupby("model")}
        found = {(m, o): _wins_and_losses(own[m], own[o], within) for m in own for o in own if m != o}
        return pd.DataFrame([(m, o, w / (w + l)) for (m, o), (w, l) in found.items() if w + l], columns=["model", "other", "v"])

    per = cells.groupBy("_item").applyInPandas(shares, "model string, other string, v double")
    return per.groupBy("model", "other").agg(F.avg("v").alias("value"))


def _wins_and_losses(a: tuple, b: tuple, within: float) -> tuple[int, int]:
    """How many pairs of the rows ``a`` and ``b`` (scores, sizes, counts) either side wins, of those close in size.

    Sorted by size, the partners of a row are a range; the smaller scores before a
    place are counted in sorted blocks of 1, 2, 4, ... rows.
    """
    score, size, count = a
    order = np.argsort(b[1], kind="stable")
    sizes, weights = b[1][order], b[2][order]
    n, values = len(sizes), np.unique(b[0])
    rank, span = np.searchsorted(values, b[0][order]), len(values) + 1
    close = lambda i: (size + sizes[i] > 0) & (np.abs(size - sizes[i]) <= within * ((size + sizes[i]) / 2))
    low = _first(lambda i: close(i) | (sizes[i] > size) | (sizes[i] == size) & (size > 0), len(size), n)
    high = _first(lambda i: (sizes[i] > size) & ~close(i), len(size), n)
    below, upto = np.searchsorted(values, score), np.searchsorted(values, score, "right")
    wins = losses = 0
    total = np.concatenate(([0], np.cumsum(weights)))
    for j in range(n.bit_length()):
        key = (np.arange(n) >> j) * span + rank
        by = np.argsort(key, kind="stable")
        key, before = key[by], np.concatenate(([0], np.cumsum(weights[by])))
        for place, sign in ((high, 1), (low, -1)):
            block = (place >> j) - 1
            use = (place >> j & 1).astype(bool)
            block, c = block[use], sign * count[use]
            start, end = total[block << j], total[(block + 1) << j]
            wins += int((c * (before[np.searchsorted(key, block * span + below[use])] - start)).sum())
            losses += int((c * (end - before[np.searchsorted(key, block * span + upto[use])])).sum())
    return wins, losses


def _first(holds, rows: int, n: int) -> np.ndarray:
    """For each row the first of n places at which a condition holds that stays true from there; n if there is none."""
    low, high = np.zeros(rows, np.int64), np.full(rows, n, np.int64)
    while (open_ := low < high).any():
        middle = np.minimum((low + high) // 2, n - 1)
        true = holds(middle)
        high, low = np.where(open_ & true, middle, high), np.where(open_ & ~true, middle + 1, low)
    return low


def bootstrap_std(df: DataFrame, by: list[str], value: str, *, rounds: int = 1000, seed: int = 7) -> DataFrame:
    """``by, std``: spread of the clipped mean over Poisson resamples; every row draws its own weights, which each task adds up in arrays."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), F.xxhash64("_id", F.lit(seed)).alias("_h"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def added(batches):
        steps = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        # the distribution function of Poisson(1)
        upto = np.array([0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406])
        sums: dict = {}
        for batch in batches:
            for key, x in batch.groupby(by, dropna=False):
                total = sums.setdefault(key, np.zeros((2, rounds)))
                for i in range(0, len(x), 1000):
                    z = x["_h"].to_numpy()[i : i + 1000].astype(np.int64).view(np.uint64)[:, None] + steps
                    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    w = np.searchsorted(upto, (z >> np.uint64(11)) / 2.0**53, "right").astype(np.float64)
                    total += np.stack((x["_v"].to_numpy()[i : i + 1000] @ w, w.sum(0)))
        yield pd.DataFrame([(*key, list(t[0]), list(t[1])) for key, t in sums.items()], columns=[*by, "_s", "_w"])

    parts = rows.mapInPandas(added, f"{kinds}, _s array<double>, _w array<double>").select(*by, F.posexplode(F.arrays_zip("_s", "_w")).alias("_round", "_x"))
    means = parts.groupBy(*by, "_round").agg((F.sum("_x._s") / F.nullif(F.sum("_x._w"), F.lit(0.0))).alias("_m"))
    return means.groupBy(*by).agg(F.stddev_pop(clip(F.col("_m"))).alias("std"))


def best_overlap_f1(text: Column, *references: Column) -> Column:
    """The largest F1 of the letter pairs of a text and of any reference, as ``text.bag_overlap_f1`` of ``text.bigrams``.

    Pairs are counted in Arrow batches: the column form takes quadratic time in the length of a text.
    """

    @F.pandas_udf("double")
    def best(*columns: pd.Series) -> pd.Series:
        return pd.Series([max(T.pairs_f1(own, T.letter_pairs(r)) for r in refs) for own, refs in ((T.letter_pairs(t), refs) for t, *refs in zip(*columns))], dtype="float64")

    return best(*map(T.letters_only, (text, *references)))


def running_record(df: DataFrame, by: list[str], order: list, value: str, best: str = "max") -> DataFrame:
    """Rows that beat every earlier row of their group; a group of any size is looked at in parts."""
    combine, extreme = (F.max, F.greatest) if best == "max" else (F.min, F.least)
    rows = over_parts(in_parts(df, by, order), by, order, value, combine)
    prev = extreme("_inside", "_before")
    better = F.col(value) > prev if best == "max" else F.col(value) < prev
    return rows.where((prev.isNull() | better) & F.col(value).isNotNull()).drop("_part", "_inside", "_before")


def mid_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, value, c, rank, all``: each distinct value of a group with its number of rows, its rank from 1 (the mean of its rows' places) and the rows of the group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    places = ordered_offsets(counts, by, [F.col(value)], "c").withColumn("rank", F.col("offset") + (F.col("c") + 1) / 2).drop("offset")
    if not by:
        return places.withColumn("all", F.lit(counts.agg(F.sum("c")).first()[0]).cast("long"))
    return places.join(counts.groupBy(*by).agg(F.sum("c").alias("all")), by)


def worst_weights(n: int, k: int) -> list[float]:
    """The weight of each sorted score in the expected minimum of k of n."""
    return [comb(n - i, k - 1) / comb(n, k) for i in range(1, n + 1)]

"""Problem 7: a mixture of sources in target shares of all tokens.

The size of each source's part follows from its weight and from what it has:
documents in hash order, repeated at most ``max_repeats`` times. What a source
cannot give is shared by the others in proportion to their weights, so the total
stays; the report names the targets missed. The order is a Pfair schedule: a
source's stream of tokens is cut into blocks, block i of a source with share u
is released at floor((i - 1) / u) and due at ceil(i / u) block times, and the
released block with the earliest deadline goes first, so no source is ever a
block away from its share. Shares are exact, and the schedule covers the whole
mixture: blocks grow with it where there would be more than ``FRAME`` of them.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions.text import name_key
from dialoom.llm.tokens import token_counts
from dialoom.operators.prefix import running_offsets
from dialoom.session import durable

#: Most blocks of a mixture (besides one unfinished block a source).
FRAME = 1 << 18
#: Least tokens of a block.
BLOCK_TOKENS = 4096
#: The schedule is made on the driver, so targets have a bound.
MAX_SOURCES = 5_000


def parts(sources: list[tuple[str, float, int, int]], total: int | None = None) -> tuple[int, dict[str, int]]:
    """Total and tokens of each source. ``sources``: name, weight, tokens, most repeats.

    Without ``total`` it is the tokens that the sources with targets have. A
    source gives its share of what is left until it is exhausted.
    """
    capacity = {n: t * r for n, _, t, r in sources}
    total = sum(t for _, _, t, _ in sources) if total is None else total
    total = min(total, sum(c for n, c in capacity.items()))
    open_ = {n: Fraction(w).limit_denominator(10**6) for n, w, t, r in sources if w > 0 and t * r > 0}
    given: dict[str, int] = {n: 0 for n, *_ in sources}
    left = Fraction(total)
    while open_:
        weight = sum(open_.values())
        full = [n for n, w in open_.items() if capacity[n] <= left * w / weight]
        if not full:
            for n, w in open_.items():
                given[n] = int(left * w / weight)
            break
        for n in full:
            given[n] = capacity[n]
            left -= capacity[n]
            del open_[n]
    return total, given


def schedule(shares: dict[str, int], block: int = 1) -> list[tuple[str, int]]:
    """The source and the number (from 0) of each block in order; ``shares`` are the tokens of each source, cut into blocks of ``block`` tokens."""
    total = sum(shares.values())
    released: list[tuple[int, str, int]] = []
    waiting = [(0, n, 1) for n, k in sorted(shares.items()) if k]
    heapq.heapify(waiting)
    out = []
    while waiting or released:
        while waiting and (waiting[0][0] <= len(out) or not released):
            _, n, i = heapq.heappop(waiting)
            heapq.heappush(released, (-(-i * total // shares[n]), n, i))
        _, n, i = heapq.heappop(released)
        out.append((n, i - 1))
        if i * block < shares[n]:
            heapq.heappush(waiting, (i * total // shares[n], n, i + 1))
    return out


def _plan(documents: DataFrame, targets: DataFrame, total: int | None, path: str | None):
    counted = documents.where("source is not null and doc_id is not null").select("doc_id", name_key(F.col("source")).alias("source"), F.col("text"))
    t = targets.where("source is not null and target_weight > 0 and not isnan(target_weight)").groupBy(name_key(F.col("source")).alias("source")).agg(F.max("target_weight").alias("w"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("r"))
    rows = t.orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    small = documents.sparkSession.createDataFrame([(r["source"],) for r in rows], "source string")
    sized = durable(token_counts(counted.join(F.broadcast(small), "source"), "doc_id", "source", path=path))  # at most MAX_SOURCES rows broadcast
    have = {r["source"]: (int(r["n"]), r["docs"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs")).collect()}
    weights = [(r["source"], float(r["w"]), have.get(r["source"], (0, 0))[0], int(r["r"])) for r in rows]
    total, given = parts(weights, total)
    return sized, weights, have, total, given


def _room() -> Column:
    """How far the middle of a document stands before the end of its source's part."""
    return F.col("_part") - F.col("n_tokens") / 2 - F.col("offset")


def mixture(documents: DataFrame, targets: DataFrame, *, total: int | None = None, seed: int = 42, frame: int = FRAME, block: int = BLOCK_TOKENS, path: str | None = None) -> DataFrame:
    """``slot, source, doc_id, repeat, offset, n_tokens``: the documents of the mixture; its order is (slot, source, offset).

    ``offset`` is the place of the document's first token in its source's stream,
    ``repeat`` says which pass over the source it is (from 0). A source ends with
    the document whose middle is the last within its part, so it misses its part
    by at most half a document. Documents without tokens, of null
    sources or of sources without a target are not used; sources compare after
    trimming and lower-casing. Repeated identifiers are different documents.
    """
    spark = documents.sparkSession
    sized, weights, have, _, given = _plan(documents, targets, total, path)
    block = max(block, -(-sum(given.values()) // frame))
    order_of = schedule(given, block)
    names, nth = zip(*order_of) if order_of else ((), ())
    table = spark.createDataFrame(pa.table({"source": pa.array(names, pa.string()), "_block": pa.array(nth, pa.int64()), "slot": pa.array(range(len(order_of)), pa.int64())}))
    plan = spark.createDataFrame([(n, have[n][0], given[n], r) for n, _, t, r in weights if given[n] > 0], "source string, _have long, _part long, _most int")
    order = F.xxhash64("doc_id", F.lit(seed))
    placed = running_offsets(sized.where("n_tokens > 0"), ["source"], order, "n_tokens", tie="doc_id").join(F.broadcast(plan), "source")  # one row a target source
    # pass p puts a document at p times the source's size: the passes follow each other in the same order
    last = F.least(F.col("_most") - 1, F.floor(_room() / F.col("_have")).cast("int"))
    passes = placed.where(_room() >= 0).withColumn("repeat", F.explode(F.sequence(F.lit(0), last)))
    passes = passes.withColumn("offset", F.col("offset") + F.col("repeat") * F.col("_have")).withColumn("_block", F.expr(f"offset div {block}"))
    return passes.join(F.broadcast(table), ["source", "_block"]).select("slot", "source", "doc_id", "repeat", "offset", "n_tokens")  # FRAME + MAX_SOURCES rows


def shares(documents: DataFrame, targets: DataFrame, *, total: int | None = None, path: str | None = None) -> DataFrame:
    """Targets against what the mixture holds, one row per source with a target.

    ``source, target_weight, target_share, max_repeats, n_docs, n_tokens,
    planned_tokens, used_docs, used_tokens, actual_share, missed``; ``missed`` is
    true where the source could not give its target share of the planned total. An empty corpus gives shares of 0.
    """
    spark = documents.sparkSession
    sized, weights, have, total, given = _plan(documents, targets, total, path)
    used = {r["source"]: r for r in _used(sized, weights, have, given).collect()}  # one row a target source
    all_used = sum(int(r["used_tokens"]) for r in used.values())
    weight = sum(w for _, w, _, _ in weights)
    rows = []
    for n, w, t, r in weights:
        u = int(used[n]["used_tokens"]) if n in used else 0
        share = w / weight
        rows.append((n, w, share, r, have.get(n, (0, 0))[1], t, given[n], int(used[n]["used_docs"]) if n in used else 0, u, u / all_used if all_used else 0.0, given[n] < int(Fraction(w).limit_denominator(10**6) * total / sum(Fraction(x[1]).limit_denominator(10**6) for x in weights))))
    return spark.createDataFrame(rows, "source string, target_weight double, target_share double, max_repeats int, n_docs long, n_tokens long, planned_tokens long, used_docs long, used_tokens long, actual_share double, missed boolean")


def _used(sized: DataFrame, weights: list, have: dict, given: dict, seed: int = 42) -> DataFrame:
    spark = sized.sparkSession
    plan = spark.createDataFrame([(n, have[n][0], given[n], r) for n, _, _, r in weights if given[n] > 0], "source string, _have long, _part long, _most int")
    placed = running_offsets(sized.where("n_tokens > 0"), ["source"], F.xxhash64("doc_id", F.lit(seed)), "n_tokens", tie="doc_id").join(F.broadcast(plan), "source")  # one row a target source
    times = F.least(F.col("_most").cast("long"), F.floor(_room() / F.col("_have")) + 1)
    return placed.where(_room() >= 0).groupBy("source").agg(F.sum(times).alias("used_docs"), F.sum(times * F.col("n_tokens")).alias("used_tokens"))

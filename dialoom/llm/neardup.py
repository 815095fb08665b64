"""Problem 2: near-duplicate texts with small edits, insertions and moved parts.

Every text becomes a set of token shingles and a fingerprint of two bits per
minimum hash, so that dissimilar texts are far apart in Hamming distance. The
fingerprints are partitioned into shards by short runs of their minimum hashes;
each is put into all ``BANDS`` shards at whose boundary it may have neighbours
(two texts of similarity 0.6 share none with a probability of 6 in 100,000, of
0.65 of 3 in a million). Inside a shard, vantage points prune by
triangle bounds and give the pairs within the Hamming radius; only those are
compared exactly, by their shingle sets. Equal sets are one point throughout.
A shard of more than ``CHUNK`` points is cut into chunks, and each pair of chunks
is searched by itself, so no task holds a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm import shingles
from dialoom.llm.shingles import distinct
from dialoom.llm.vptree import LEAF, close_pairs
from dialoom.operators.components import connected_components
from dialoom.session import durable

BANDS, ROWS = 40, 3
#: Minimum hashes of a fingerprint, two bits each.
FINGERPRINT = 96
#: Most points of a shard that are searched at once.
CHUNK = 4096
#: Sets that a task remembers in order not to send a copy of one to the shards again.
REMEMBERED = 200_000
#: Most bits of a filter (it is sized by its values, gathered and sent to the workers); with more values there is none.
FILTER_BITS = 1 << 27


def pair_text() -> Column:
    return F.concat(F.coalesce(F.col("question"), F.lit("")), F.lit("\n"), F.coalesce(F.col("response_chosen"), F.lit("")))


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number for each run of ``rows`` minimum hashes (one row a set): equal where the runs are."""
    key = np.zeros((len(low), bands), np.uint64)
    for r in range(rows):
        key = shingles.mix(key ^ low[:, r::rows] + np.arange(1, bands + 1, dtype=np.uint64))
    return key


def unseen(ids: np.ndarray, seen: set[int], most: int) -> np.ndarray:
    """Which of the numbers are not in ``seen``; they are put into it, and it is emptied when it holds more than ``most``."""
    fresh = np.zeros(len(ids), bool)
    for i, one in enumerate(ids.tolist()):
        if one not in seen:
            fresh[i] = True
            seen.add(one)
    if len(seen) > most:
        seen.clear()
    return fresh


def sketches(texts: DataFrame, *, width: int = 3, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``id, set_id, f0, f1, f2, bands`` of every text (``id``, ``text``) with at least one shingle.

    ``f0..f2`` is the fingerprint, ``bands`` the shards; they are empty where the task has sent an equal set before.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                h, sizes = shingles.sets(part.column(1).to_pylist(), width)
                has = sizes > 0
                sizes = sizes[has]
                low = shingles.minhashes(h, sizes, bands * rows)
                words = shingles.fingerprint(low[:, :FINGERPRINT]).view(np.int64)
                own = shingles.set_identity(h, sizes).view(np.int64)
                fresh = unseen(own, seen, REMEMBERED)
                key = band_keys(low[fresh], bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(fresh) * bands)), pa.int32()), pa.array(key.reshape(-1).view(np.int64)))
                ids = part.column(0).filter(pa.array(has))
                yield pa.RecordBatch.from_arrays([ids, pa.array(own), *[pa.array(words[:, i]) for i in range(3)], lists], names=["id", "set_id", "f0", "f1", "f2", "bands"])

    return texts.select("id", "text").mapInArrow(sketch, "id bigint, set_id bigint, f0 bigint, f1 bigint, f2 bigint, bands array<bigint>")


def _search(r: int):
    """Over rows (shard, set, fingerprint, side) sorted by shard: pairs of sets whose fingerprints are within ``r``.

    Where a shard has two sides only pairs across them are looked for.
    """

    def pairs_of(shard: np.ndarray, ids: np.ndarray, points: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        edge = np.flatnonzero(np.concatenate((distinct(shard), [True])))
        size = np.diff(edge)
        for at in np.flatnonzero(size > LEAF):
            here = slice(edge[at], edge[at + 1])
            i, j = close_pairs(points[here], r, side[here])
            left.append(ids[edge[at] + i])
            right.append(ids[edge[at] + j])
        # shards that are a leaf are compared along the sorted rows, all at once
        keep = np.repeat((size > 1) & (size <= LEAF), size)
        shard, ids, points, side = shard[keep], ids[keep], points[keep], side[keep]
        for step in range(1, LEAF):
            i = np.flatnonzero(shard[step:] == shard[:-step])
            if not len(i):
                break
            i = i[(np.bitwise_count(points[i] ^ points[i + step]).sum(axis=1) <= r) & ((side[i] == 0) | (side[i] != side[i + step]))]
            left.append(ids[i])
            right.append(ids[i + step])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = np.concatenate(left), np.concatenate(right)
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((hi, lo))
        lo, hi = lo[order], hi[order]
        once = distinct(lo) | distinct(hi)
        return lo[once], hi[once]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_shards(batches, 6):
            a, b = pairs_of(rows[:, 0], rows[:, 1], np.ascontiguousarray(rows[:, 2:5]).view(np.uint64), rows[:, 5])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return search


def _whole_shards(batches: Iterator[pa.RecordBatch], columns: int, least: int = 100_000) -> Iterator[np.ndarray]:
    """Rows sorted by their first column, in blocks that never part a value of it."""
    rest: list[np.ndarray] = []
    for batch in _with_end(batches):
        if batch is not None:
            rest.append(np.stack([batch.column(i).to_numpy() for i in range(columns)], 1))
            if sum(map(len, rest)) < least:
                continue
        if not rest:
            continue
        rows = np.concatenate(rest)
        cut = len(rows) if batch is None else int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        rest = [rows[cut:]]
        if cut:
            yield rows[:cut]


def _with_end(batches):
    yield from batches
    yield None


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (shard, set) sorted by both: sets that are not alone in their shard, once each, with the chunk of the shard they are in."""
    last, before, nth, held = None, None, 0, None  # the shard and the set at the end of what was read, the shard's sets so far, and its only one
    for batch in batches:
        shard, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(shard):
            continue
        once = distinct(shard) | distinct(ids)
        once[0] = shard[0] != last or ids[0] != before
        before = ids[-1]
        shard, ids = shard[once], ids[once]
        if not len(shard):
            continue
        new = distinct(shard)
        new[0] = shard[0] != last
        place = np.arange(len(shard))
        at = place - np.maximum.accumulate(np.where(new, place, 0)) + np.where(np.cumsum(new) == 0, nth, 0)
        follows = np.concatenate((~new[1:], [False]))
        meet = (at > 0) | follows
        out_shard, out_id, out_at = shard[meet], ids[meet], at[meet]
        if held is not None and not new[0]:
            out_shard, out_id, out_at = np.append(out_shard, last), np.append(out_id, held), np.append(out_at, 0)
        last, nth = shard[-1], int(at[-1]) + 1
        held = ids[-1] if nth == 1 else None
        yield pa.RecordBatch.from_arrays([pa.array(out_shard), pa.array(out_id), pa.array((out_at // CHUNK).astype(np.int32))], names=["shard", "set_id", "chunk"])


def candidates(sketched: DataFrame, *, similarity: float, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``a, b``: distinct pairs of sets (a < b) that share a shard and lie within the Hamming radius."""
    points = sketched.select(F.explode("bands").alias("shard"), "set_id")
    met = durable(points.repartition("shard").sortWithinPartitions("shard", "set_id").mapInArrow(_meetings, "shard bigint, set_id bigint, chunk int"))
    large = met.where("chunk > 0").groupBy("shard").agg((F.max("chunk") + 1).alias("chunks"))
    placed = met.join(large, "shard", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    # the cells of a large shard: each chunk with itself and with every other one
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cell = F.when(F.col("chunks") == 1, F.col("shard")).otherwise(F.xxhash64("shard", F.least("chunk", "other"), F.greatest("chunk", "other")))
    side = F.when(F.col("chunk") < F.col("other"), 1).when(F.col("chunk") > F.col("other"), 2).otherwise(0).cast("bigint")
    placed = placed.select("set_id", cell.alias("cell"), side.alias("side")).join(sketched.select("set_id", "f0", "f1", "f2").dropDuplicates(["set_id"]), "set_id")
    r = shingles.radius(FINGERPRINT, similarity)
    return placed.select("cell", "set_id", "f0", "f1", "f2", "side").repartition("cell").sortWithinPartitions("cell").mapInArrow(_search(r), "a bigint, b bigint").distinct()


def _filter(values: DataFrame, column: str) -> tuple | None:
    """A one-hash Bloom filter over a column: bits sized by its rows, at most FILTER_BITS, gathered as one word each; None where it would fill up."""
    n = values.count()
    if 4 * n > FILTER_BITS:
        return None
    bits = 1 << 12
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2
    place = values.select(F.pmod(F.col(column), F.lit(bits)).alias("p"))
    words = place.selectExpr("cast(p div 64 as int) as w", "shiftleft(1L, cast(p % 64 as int)) as m").groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    table = np.zeros(bits // 64, np.int64)
    table[words["w"].to_numpy()] = words["m"].to_numpy()
    return bits, table.view(np.uint64)


def shared_filter(session, found: tuple | None) -> tuple | None:
    """The filter as the workers take it (at most FILTER_BITS / 8 bytes)."""
    return found and (found[0], session.sparkContext.broadcast(found[1]))


def passes(h: np.ndarray, shared: tuple | None) -> np.ndarray:
    """Which of the numbers may be in the filter; all without one."""
    if shared is None:
        return np.ones(len(h), bool)
    place = h & np.uint64(shared[0] - 1)
    return ((shared[1].value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)


def shingle_sets(texts: DataFrame, wanted: DataFrame, *, width: int = 3) -> DataFrame:
    """``set_id, shingles`` (32-bit hashes) of the texts whose set is among ``wanted`` (``set_id``), one row per distinct set.

    A filter keeps the others from being shuffled; where there are too many wanted sets for one, the join sorts them out.
    """
    found = _filter(wanted, "set_id")
    shared = shared_filter(texts.sparkSession, found)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                h, sizes = shingles.sets(part.column(0).to_pylist(), width)
                ids = shingles.set_identity(h, sizes)
                keep = (sizes > 0) & passes(ids, shared)
                h = h[np.repeat(keep, sizes)]
                ends = np.concatenate(([0], np.cumsum(sizes[keep])))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((h & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep].view(np.int64)), lists], names=["set_id", "shingles"])

    sets = texts.select("text").mapInArrow(pick, "set_id bigint, shingles array<int>")
    if found is None:
        sets = sets.join(wanted.select("set_id").distinct(), "set_id", "left_semi")
    return sets.groupBy("set_id").agg(F.first("shingles").alias("shingles"))


def similar_sets(texts: DataFrame, sketched: DataFrame, *, similarity: float, width: int = 3, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``a, b, similarity``: the pairs of distinct sets that reach ``similarity``, compared exactly."""
    pairs = durable(candidates(sketched, similarity=similarity, bands=bands, rows=rows))
    known = shingle_sets(texts, pairs.select(F.explode(F.array("a", "b")).alias("set_id")), width=width)
    both = pairs.join(known.select(F.col("set_id").alias("a"), F.col("shingles").alias("sa")), "a").join(known.select(F.col("set_id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("similarity")).where(F.col("similarity") >= similarity)


def similar_pairs(texts: DataFrame, *, similarity: float = 0.6, width: int = 3) -> DataFrame:
    """``id_a, id_b`` (a < b) of all texts (``id``, ``text``) that reach ``similarity``; rows with equal sets are pairs too."""
    sketched = durable(sketches(texts, width=width))
    sets = durable(similar_sets(texts, sketched, similarity=similarity, width=width))
    members = sketched.select("id", "set_id")
    left, right = (members.select(F.col("id").alias(f"id_{s}"), F.col("set_id").alias(s)) for s in "ab")
    apart = sets.select("a", "b").join(left, "a").join(right, "b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    copies = left.join(right.withColumnRenamed("b", "a"), "a").where("id_a < id_b").select("id_a", "id_b")
    return apart.unionByName(copies)


def found(pairs: DataFrame, *, similarity: float = 0.6) -> DataFrame:
    """``pair_id_a, pair_id_b`` of all near-duplicate rows. Null questions and answers count as empty; texts under three tokens have no partner."""
    texts = pairs.where(F.col("pair_id").isNotNull()).select(F.col("pair_id").alias("id"), pair_text().alias("text"))
    return similar_pairs(texts, similarity=similarity).select(F.col("id_a").alias("pair_id_a"), F.col("id_b").alias("pair_id_b"))


def groups(pairs: DataFrame, *, similarity: float = 0.6) -> DataFrame:
    """``pair_id, class_id, n_copies, n_links``, one row per row in a class of at least two.

    A class is a connected component of near duplicates and is named after its
    smallest ``pair_id``; ``n_copies`` counts the rows with the same set (this
    one included), ``n_links`` the different sets linked to this one. Copies are
    counted, never paired with each other.
    """
    texts = pairs.where(F.col("pair_id").isNotNull()).select(F.col("pair_id").alias("id"), pair_text().alias("text"))
    sketched = durable(sketches(texts))
    sets = durable(similar_sets(texts, sketched, similarity=similarity))
    links = sets.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count(F.lit(1)).alias("n_links"))
    parts = connected_components(sets).withColumnRenamed("node", "set_id")
    per_set = sketched.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_copies"), F.min("id").alias("_first"))
    per_set = per_set.join(parts, "set_id", "left").join(links, "set_id", "left").where("n_copies > 1 or n_links > 0")
    per_set = durable(per_set.withColumn("component", F.coalesce("component", "set_id")))
    names = per_set.groupBy("component").agg(F.min("_first").alias("class_id"))
    per_set = per_set.join(names, "component").select("set_id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return sketched.select(F.col("id").alias("pair_id"), "set_id").join(per_set, "set_id").select("pair_id", "class_id", "n_copies", "n_links")

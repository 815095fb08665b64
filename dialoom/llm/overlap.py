"""Problem 5: the same or nearly the same records in training and other splits.

By similarity (:func:`found`): a prefix join. Sets of similarity 0.6 share at least
0.6 n shingles of the larger set, so of any n - 0.6 n + 1 segments of three tokens
one is whole in both: each set offers so many, those first that are rare over all
texts. A filter over the evaluation segments drops the training segments that match
none before anything is shuffled. Matches whose fingerprints are too far apart end
in the join itself; the rest are compared exactly. A verification by edit distance
would lose moved parts (see the README), so the exact check is on the sets.

By edit distance (:func:`edit_pairs`): evaluation strings are cut into k + 1
segments, training strings offer their substrings at the positions that k edits
allow, and what meets is verified by dynamic programming within a band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.functions.text import name_key
from dialoom.llm import shingles
from dialoom.llm.neardup import REMEMBERED, _filter, passes, shared_filter, shingle_sets, unseen
from dialoom.session import durable

#: Places of the counts of shingles.
BUCKETS = 1 << 18
#: Minimum hashes of a fingerprint, two bits each.
FINGERPRINT = 96


def _rows(batches: Iterator[pa.RecordBatch], column: int):
    for batch in batches:
        for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
            h, sizes = shingles.sets(part.column(column).to_pylist())
            yield part, h, sizes


def prefix(h: np.ndarray, sizes: np.ndarray, similarity: float, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each set of which similar sets share at least one, and the number of the set; ``common``: counts by which rare ones come first."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((h, common[(h & np.uint64(len(common) - 1)).astype(np.int64)], doc))
    most = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    use = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < most[doc]
    return h[order][use], doc[use]


def _common(texts: DataFrame) -> np.ndarray:
    """Counts of the shingles of all texts in buckets of fixed number; they only order shingles, so clashes do no harm."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, h, _ in _rows(batches, 0):
            total += np.bincount((h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def _prefixes(similarity: float, common, wanted=None):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, h, sizes in _rows(batches, 0):
            ids = shingles.set_identity(h, sizes)
            fresh = unseen(ids, seen, REMEMBERED) & (sizes > 0)
            if not fresh.any():
                continue
            h, sizes, ids = h[np.repeat(fresh, sizes)], sizes[fresh], ids[fresh]
            words = shingles.fingerprint(shingles.minhashes(h, sizes, FINGERPRINT))
            k, doc = prefix(h, sizes, similarity, common.value)
            use = passes(k, wanted)
            k, doc = k[use], doc[use]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (k, ids[doc], *(words[doc, i] for i in range(3)))], names=["shingle", "set_id", "f0", "f1", "f2"])

    return prefixes


_PREFIXES = "shingle bigint, set_id bigint, f0 bigint, f1 bigint, f2 bigint"


def _set_ids(rows: DataFrame) -> DataFrame:
    """``id, set_id`` of the texts with a shingle."""

    def ids(batches):
        for part, h, sizes in _rows(batches, 1):
            has = sizes > 0
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(has)), pa.array(shingles.set_identity(h, sizes)[has].view(np.int64))], names=["id", "set_id"])

    return rows.select("id", "text").mapInArrow(ids, "id bigint, set_id bigint")


def prepared(candidates: DataFrame) -> DataFrame:
    """``id, split, source_dataset, hash, text`` of the rows with a split; ``hash`` is null unless it is 40 hexadecimal digits."""
    hashed = F.lower("source_hash")
    return candidates.where("cand_id is not null and source_split is not null").select(
        F.col("cand_id").alias("id"), name_key(F.col("source_split")).alias("split"), "source_dataset", F.when(hashed.rlike("^[0-9a-f]{40}$"), hashed).alias("hash"), F.col("question").alias("text")
    )


def similar_sets(evaluation: DataFrame, train: DataFrame, *, similarity: float = 0.6) -> DataFrame:
    """``e, t``: distinct sets of the evaluation and the training texts that reach ``similarity``, equal sets included."""
    common = train.sparkSession.sparkContext.broadcast(_common(evaluation.select("text").unionAll(train.select("text"))))  # BUCKETS numbers
    # copies mostly end in the task that reads them; one shuffle by shingle serves what is left of them and the join
    cut = durable(evaluation.select("text").mapInArrow(_prefixes(similarity, common), _PREFIXES).repartition("shingle").distinct())
    wanted = shared_filter(train.sparkSession, _filter(cut, "shingle"))
    offered = train.select("text").mapInArrow(_prefixes(similarity, common, wanted), _PREFIXES).repartition("shingle").distinct()
    far = sum((F.bit_count(F.col(f"f{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(3)), F.lit(0))
    t = offered.select("shingle", F.col("set_id").alias("t"), *(F.col(f"f{i}").alias(f"t{i}") for i in range(3)))
    near = cut.withColumnRenamed("set_id", "e").join(t, "shingle").where(far <= shingles.radius(FINGERPRINT, similarity)).select("e", "t").distinct()
    near = durable(near)
    equal = near.where("e = t")
    near = near.where("e <> t")
    texts = evaluation.select("text").unionAll(train.select("text"))
    known = shingle_sets(texts, near.select(F.explode(F.array("e", "t")).alias("set_id")))
    both = near.join(known.select(F.col("set_id").alias("e"), F.col("shingles").alias("se")), "e").join(known.select(F.col("set_id").alias("t"), F.col("shingles").alias("st")), "t")
    common = F.size(F.array_intersect("se", "st"))
    return both.where(common >= similarity * (F.size("se") + F.size("st") - common)).select("e", "t").unionByName(equal)


def _sides(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = prepared(candidates)
    return rows.where("split <> 'train'"), rows.where("split = 'train'")


def found(candidates: DataFrame, *, similarity: float = 0.6) -> DataFrame:
    """``cand_id_a, cand_id_b`` (a < b): training rows and rows of another split with the same hash or similar questions.

    Null splits, hashes that are not 40 hexadecimal digits and questions of fewer
    than three tokens have no partner; a pair found by both ways comes once.
    """
    evaluation, train = _sides(candidates)
    sets = durable(similar_sets(evaluation, train, similarity=similarity))
    e = _set_ids(evaluation).select(F.col("id").alias("x"), F.col("set_id").alias("e"))
    t = _set_ids(train).select(F.col("id").alias("y"), F.col("set_id").alias("t"))
    by_text = sets.join(e, "e").join(t, "t").select("x", "y")
    by_hash = evaluation.where("hash is not null").select(F.col("id").alias("x"), "hash").join(train.where("hash is not null").select(F.col("id").alias("y"), "hash"), "hash").select("x", "y")
    return by_text.unionByName(by_hash).select(F.least("x", "y").alias("cand_id_a"), F.greatest("x", "y").alias("cand_id_b")).distinct()


def report(candidates: DataFrame, *, similarity: float = 0.6) -> DataFrame:
    """Overlaps per split and source: ``split, source_dataset, n_rows, n_same_hash, n_same_text, n_similar_text, n_overlapping``.

    Counts rows of the splits other than training that meet at least one training
    row; no pairs are built for copies. ``n_similar_text`` includes equal sets.
    """
    evaluation, train = _sides(candidates)
    sets = durable(similar_sets(evaluation, train, similarity=similarity))
    of_set = sets.groupBy(F.col("e").alias("set_id")).agg(F.lit(True).alias("similar"), F.max(F.col("e") == F.col("t")).alias("same"))
    hashes = train.where("hash is not null").select("hash").distinct().withColumn("hashed", F.lit(True))
    rows = evaluation.select("id", "split", "source_dataset", "hash").join(_set_ids(evaluation).join(of_set, "set_id").select("id", "similar", "same"), "id", "left").join(hashes, "hash", "left")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy("split", "source_dataset").agg(
        F.count(F.lit(1)).alias("n_rows"),
        count(F.col("hashed")).alias("n_same_hash"),
        count(F.col("same")).alias("n_same_text"),
        count(F.col("similar")).alias("n_similar_text"),
        count(F.coalesce("hashed", F.lit(False)) | F.coalesce("similar", F.lit(False))).alias("n_overlapping"),
    )


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse among the 64-bit numbers
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    for i in range(1, n):
        out[i] = (int(out[i - 1]) * base) & 0xFFFFFFFFFFFFFFFF
    return out


class _Strings:
    """Token strings of a block with hashes of any of their substrings."""

    def __init__(self, texts: list[str | None]):
        self.tokens, self.sizes = shingles.tokenized(texts)
        self.first = np.cumsum(self.sizes) - self.sizes
        longest = int(self.sizes.max(initial=0)) + 1
        self.back = _powers(_INVERSE, longest)
        place = np.arange(len(self.tokens)) - np.repeat(self.first, self.sizes)
        self.upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(shingles.mix(self.tokens) * _powers(_BASE, longest)[place])))

    def part(self, of: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        at = self.first[of] + start
        return (self.upto[at + length] - self.upto[at]) * self.back[start]

    def names(self) -> np.ndarray:
        every = np.arange(len(self.sizes))
        return shingles.mix(self.part(every, np.zeros(len(every), np.int64), self.sizes) + self.sizes.astype(np.uint64) * np.uint64(_INVERSE))


def _segment(n: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of strings of n tokens cut into edits + 1 even segments, the longer ones last."""
    short, longer = n // (edits + 1), n % (edits + 1)
    before = edits + 1 - longer
    return i * short + np.maximum(0, i - before), short + (i >= before)


def segments(strings: _Strings, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Key and string number of the segments of each string of more than ``edits`` tokens."""
    of = np.flatnonzero(strings.sizes > edits)
    n = strings.sizes[of]
    keys = []
    for i in range(edits + 1):
        start, length = _segment(n, i, edits)
        keys.append(_segment_key(strings.part(of, start, length), n, i))
    return np.concatenate(keys), np.tile(of, edits + 1)


def substrings(strings: _Strings, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Key and string number of the substrings that a segment of a string within ``edits`` can be whole in.

    Segment i can have moved by at most i edits on its left and edits - i on its right.
    """
    keys, whose = [], []
    for delta in range(-edits, edits + 1):
        n = strings.sizes - delta  # the length of the string that is cut
        of = np.flatnonzero((n > edits) & (strings.sizes > 0))
        for i in range(edits + 1):
            start, length = _segment(n[of], i, edits)
            for move in range(max(-i, delta - (edits - i)), min(i, delta + (edits - i)) + 1):
                at = start + move
                fits = (at >= 0) & (at + length <= strings.sizes[of])
                keys.append(_segment_key(strings.part(of[fits], at[fits], length[fits]), n[of[fits]], i))
                whose.append(of[fits])
    return np.concatenate(keys), np.concatenate(whose)


def _segment_key(h: np.ndarray, n: np.ndarray, i: int) -> np.ndarray:
    return shingles.mix(h ^ shingles.mix(n.astype(np.uint64) * np.uint64(64) + np.uint64(i)))


def banded_distance(a: list[np.ndarray], b: list[np.ndarray], edits: int) -> np.ndarray:
    """The edit distance of each pair of token strings, or edits + 1 where it is larger; only a band of 2 edits + 1 diagonals is computed."""
    n = np.array([len(x) for x in a], np.int64)
    m = np.array([len(x) for x in b], np.int64)
    far = edits + 1
    width, rows = 2 * edits + 1, int(n.max(initial=0))
    x = np.zeros((len(a), rows), np.uint64)
    y = np.zeros((len(b), rows + 2 * width + int(m.max(initial=0))), np.uint64)
    for k in range(len(a)):
        x[k, : n[k]] = a[k]
        y[k, edits : edits + m[k]] = b[k]
    shift = np.arange(-edits, edits + 1)
    row = np.where((shift >= 0) & (shift <= m[:, None]), shift, far)
    out = np.full(len(a), far)
    in_band = np.abs(m - n) <= edits
    done = (n == 0) & in_band
    out[done] = row[done, (m - n + edits)[done]]
    for i in range(1, rows + 1):
        j = i + shift
        same = x[:, i - 1, None] == y[:, i - 1 : i - 1 + width]
        valid = (j >= 0) & (j <= m[:, None])
        nxt = np.minimum(row + np.where(same & (j >= 1), 0, 1), np.concatenate((row[:, 1:] + 1, np.full((len(a), 1), far)), 1))
        nxt[:, j == 0] = i
        for k in range(1, width):
            nxt[:, k] = np.minimum(nxt[:, k], nxt[:, k - 1] + 1)
        row = np.where(valid, np.minimum(nxt, far), far)
        done = (n == i) & in_band
        out[done] = row[done, (m - n + edits)[done]]
    return out


def edit_pairs(evaluation: DataFrame, train: DataFrame, *, edits: int = 4) -> DataFrame:
    """``id_e, id_t, distance, copies_e, copies_t``: texts (``id``, ``text``) of both sides within ``edits`` token edits.

    One row per pair of different token strings, named by the smallest identifier
    of each side, with how many rows have it. Null texts and texts without a token
    have no partner; those of at most ``edits`` tokens only meet equal ones.
    """
    spark = evaluation.sparkSession

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                strings = _Strings(part.column(1).to_pylist())
                has = strings.sizes > 0
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(has)), pa.array(strings.names()[has].view(np.int64))], names=["id", "string"])

    def offers(make, wanted=None):
        def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                    strings = _Strings(part.column(0).to_pylist())
                    own = strings.names()
                    keys, of = make(strings, edits)
                    use = unseen(own, seen, REMEMBERED)[of] & passes(keys, wanted)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[use].view(np.int64)), pa.array(own[of[use]].view(np.int64))], names=["segment", "string"])

        return offer

    def tokens_of(batches: Iterator[pa.RecordBatch], wanted=None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                strings = _Strings(part.column(0).to_pylist())
                own = strings.names()
                keep = (strings.sizes > 0) & passes(own, wanted)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(strings.sizes[keep]))), pa.int32()), pa.array(strings.tokens[np.repeat(keep, strings.sizes)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(own[keep].view(np.int64)), lists], names=["string", "tokens"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                a, b = ([np.asarray(x.values, np.int64).view(np.uint64) if x.is_valid else np.zeros(0, np.uint64) for x in part.column(c)] for c in (2, 3))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(banded_distance(a, b, edits).astype(np.int32))], names=["e", "t", "distance"])

    sides = [durable(x.select("id", "text").mapInArrow(names, "id bigint, string bigint")) for x in (evaluation, train)]
    cut = durable(evaluation.select("text").mapInArrow(offers(segments), "segment bigint, string bigint").distinct())
    wanted = shared_filter(spark, _filter(cut, "segment"))
    offered = train.select("text").mapInArrow(offers(substrings, wanted), "segment bigint, string bigint").distinct()
    met = cut.withColumnRenamed("string", "e").join(offered.withColumnRenamed("string", "t"), "segment").select("e", "t").distinct()
    met = durable(met.where("e <> t"))
    ends = met.select(F.explode(F.array("e", "t")).alias("string"))
    wanted = shared_filter(spark, _filter(ends, "string"))
    known = evaluation.select("text").unionAll(train.select("text")).mapInArrow(lambda batches: tokens_of(batches, wanted), "string bigint, tokens array<bigint>")
    known = known.join(ends.distinct(), "string", "left_semi").groupBy("string").agg(F.first("tokens").alias("tokens"))
    both = met.join(known.select(F.col("string").alias("e"), F.col("tokens").alias("a")), "e").join(known.select(F.col("string").alias("t"), F.col("tokens").alias("b")), "t")
    near = both.select("e", "t", "a", "b").mapInArrow(verify, "e bigint, t bigint, distance int").where(F.col("distance") <= edits)
    of = [x.groupBy("string").agg(F.min("id").alias(f"id_{n}"), F.count(F.lit(1)).alias(f"copies_{n}")) for n, x in zip("et", sides)]
    equal = of[0].join(of[1], "string").withColumn("distance", F.lit(0))
    near = near.join(of[0].withColumnRenamed("string", "e"), "e").join(of[1].withColumnRenamed("string", "t"), "t")
    columns = ["id_e", "id_t", "distance", "copies_e", "copies_t"]
    return equal.select(columns).unionByName(near.select(columns))


def edits_found(candidates: DataFrame, *, edits: int = 4) -> DataFrame:
    """:func:`edit_pairs` of the questions of the evaluation splits and the training split."""
    evaluation, train = _sides(candidates)
    return edit_pairs(evaluation, train, edits=edits)

"""Character n-grams of many texts as a sparse matrix: vocabulary by total count, counts packed by row, products with dense matrices.

The vocabulary is that of ``CountVectorizer``: of the n-grams in at least
``minDF`` and at most ``maxDF`` texts, the ``vocabSize`` of the highest total
count; equal counts, which it leaves open, go by code. It is found without
sending every n-gram around: each part of the texts names its most frequent
ones and the count below which it named none, so that totals have bounds from
both sides. What can't reach the vocabulary by its upper bound is left out,
the rest is counted in full. N-grams are 64-bit codes, linear in the code
points with odd factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import text as T
from dialoom.session import durable

LOW, HIGH = 2, 4
#: Factors of the code points by place.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: N-grams a part of the texts may hold before it is reported.
PART = 3_000_000
#: Characters and rows that are worked on at once.
CHARS, ROWS = 60_000, 512
#: Numbers in a dense block at most.
BLOCK = 8_000_000
#: Slots, in bits, of the table that finds an n-gram.
SLOTS = 20
#: With more tasks than this the parts of a product are added up by tasks, else by the driver.
FEW_TASKS = 32


class Packed(NamedTuple):
    """``rows`` with the binary columns ``_places`` and ``_counts`` (int32 each); by place, the code, whether it is in the vocabulary, and its inverse document frequency, 0 where it isn't; how many rows."""

    rows: DataFrame
    codes: np.ndarray
    chosen: np.ndarray
    idf: np.ndarray
    n: int


def folded(c: Column) -> Column:
    return F.lower(T.collapse(c))


def codes_of(texts: pa.Array):
    """For slices of the texts: number of the first text, codes of all n-grams of the slice and the text of each, from 0 in the slice."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + 2 * CHARS, "right")) - 1)
        if at[last] > at[first]:
            raw = data.slice(at[first], at[last] - at[first]).to_pybytes()
            c = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            begins = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            ends = np.concatenate([[0], begins])[at[first : last + 1] - at[first]]
            of = np.repeat(np.arange(last - first, dtype=np.int32), np.diff(ends))
            code, codes, texts_of = c * FACTORS[0], [], []
            for n in range(LOW, HIGH + 1):
                code = code[:-1] + c[n - 1 :] * FACTORS[n - 1]
                if not len(code):
                    break
                same = of[: len(code)] == of[n - 1 :]
                codes.append(code[same])
                texts_of.append(of[: len(code)][same])
            if codes:
                yield first, np.concatenate(codes), np.concatenate(texts_of)
        first = last


def _added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, with the sums of their counts."""
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, int)
    return codes[at], np.add.reduceat(counts, at) if len(at) else counts


def _bounds(df: DataFrame, text: str, most: int) -> DataFrame:
    """``code``, ``least`` and ``over`` of n-grams that a part of the texts has among its ``most`` most frequent: their sum there, and that less the sum of the parts' cutoffs. Code null: minus a part's cutoff."""

    def named(batches):
        codes, counts, waiting, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merged():
            nonlocal codes, counts, waiting, size
            one, n = np.unique(np.concatenate(waiting), return_counts=True)
            codes, counts = _added(np.concatenate([codes, one]), np.concatenate([counts, n]))
            waiting, size = [], 0

        def reported():
            nonlocal codes, counts
            cutoff = 0
            if len(codes) > most:
                cutoff = int(np.partition(counts, -most - 1)[-most - 1])
                codes, counts = codes[counts > cutoff], counts[counts > cutoff]
            out = pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(counts), pa.array(counts - cutoff)], names=["code", "least", "over"])
            codes, counts = codes[:0], counts[:0]
            return [out, pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0]), pa.array([-cutoff])], names=["code", "least", "over"])]

        for batch in batches:
            for _, c, _ in codes_of(batch.column(0)):
                waiting.append(c)
                size += len(c)
                if size > PART:
                    merged()
                    if len(codes) > PART:
                        yield from reported()
        if waiting:
            merged()
        if len(codes):
            yield from reported()

    parts = df.select(folded(F.col(text))).mapInArrow(named, "code long, least long, over long")
    return durable(parts.groupBy("code").agg(F.sum("least").alias("least"), F.sum("over").alias("over")))


def _candidates(bounds: DataFrame, wanted: int, least: int) -> tuple[np.ndarray, int, bool]:
    """Codes of all n-grams whose total may be at least that of number ``wanted``, the most frequent first; that total; whether no others have it for sure."""
    top = bounds.where("code is not null").select("least").orderBy(F.desc("least")).limit(wanted).agg(F.count("least"), F.min("least")).first()
    total = max(least, top[1]) if top[0] == wanted else least
    missed = -(bounds.where("code is null").agg(F.sum("over")).first()[0] or 0)
    found = bounds.where(F.col("code").isNotNull() & (F.col("over") + missed >= total)).orderBy(F.desc("least"), "code").select("code").toPandas()["code"].to_numpy(np.int64)
    return found.view(np.uint64), int(total), missed < total


def finder(codes: np.ndarray):
    """A function that gives the places of codes among ``codes``, and whether they are there at all."""
    if not len(codes):
        return lambda c: (np.zeros(0, np.int32), np.zeros(len(c), bool))
    order = np.argsort(codes)
    held = codes[order]
    shift = np.uint64(64 - SLOTS)
    slot = np.full(1 << SLOTS, -1, np.int32)
    at = (held >> shift).astype(np.int64)
    slot[at] = np.arange(len(held))
    shared = np.flatnonzero(np.bincount(at, minlength=1 << SLOTS) > 1)
    slot[shared] = -2
    order = order.astype(np.int32)

    def find(c):
        i = slot[c >> shift]
        many = np.flatnonzero(i == -2)
        i[many] = np.minimum(np.searchsorted(held, c[many]), len(held) - 1)
        there = held[i] == c
        return order[i[there]], there

    return find


def _packed(df: DataFrame, text: str, codes: np.ndarray) -> DataFrame:
    """``df`` with the places of its n-grams in ``codes`` and their counts, written."""
    shared = df.sparkSession.sparkContext.broadcast(codes)

    def packed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find = None
        for series in texts:
            find = find or finder(shared.value)
            width = len(shared.value)
            out_places, out_counts = [b""] * len(series), [b""] * len(series)
            for first, c, of in codes_of(pa.array(series, pa.large_string())):
                place, there = find(c)
                key = of[there].astype(np.int64) * width + place
                key, n = np.unique(key.astype(np.int32) if (int(of[-1]) + 1) * width < 1 << 31 else key, return_counts=True)
                of, place, n = key // width, (key % width).astype(np.int32), n.astype(np.int32)
                at = np.searchsorted(of, np.arange(int(of[-1]) + 2)) if len(of) else [0]
                for i, (a, b) in enumerate(zip(at[:-1], at[1:]), first):
                    out_places[i], out_counts[i] = place[a:b].tobytes(), n[a:b].tobytes()
            yield pd.DataFrame({"places": out_places, "counts": out_counts})

    both = F.pandas_udf(packed, "places binary, counts binary")
    # by script (bytes a character), so that rows that lie together share their n-grams
    rows = df.sortWithinPartitions(F.try_divide(F.octet_length(text), F.length(text))).withColumn("_packed", both(folded(F.col(text)))).select(*df.columns, F.col("_packed.places").alias("_places"), F.col("_packed.counts").alias("_counts"))
    return durable(rows, compression="zstd")


def _csr(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row bounds, places and counts of a batch of ``_places, _counts``."""
    ints = lambda c: (np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1], np.frombuffer(c.buffers()[2] or b"", np.uint8))
    (at, data), (cat, counts) = ints(batch.column(0)), ints(batch.column(1))
    return (at - at[0]) // 4, data[at[0] : at[-1]].view(np.int32), counts[cat[0] : cat[-1]].view(np.int32)


def tasks(df: DataFrame) -> int:
    return max(2, 2 * df.sparkSession.sparkContext.defaultParallelism)


def few(df: DataFrame) -> DataFrame:
    """In two parts a core at most: each sends a result of the size of the vocabulary."""
    return df.coalesce(tasks(df))


def counted(df: DataFrame, text: str, counter) -> Packed:
    """The n-grams of ``df`` in the vocabulary that the ``CountVectorizer`` ``counter`` asks for."""
    size, n = counter.getVocabSize(), df.count()
    low, high = (x if x >= 1 else x * n for x in (counter.getMinDF(), counter.getMaxDF()))
    low = max(1, low)
    wanted, most, bounds = size + size // 8, 4 * size, None
    while True:
        if bounds is None:
            bounds = _bounds(df, text, most)
        codes, total, sure = _candidates(bounds, wanted, int(np.ceil(low)))
        if not sure:
            most, bounds = 4 * most, None
            continue
        rows = _packed(df, text, codes)
        width = len(codes)

        def sums(batches, width=width):
            all_, texts = np.zeros(width, np.int64), np.zeros(width, np.int64)
            for batch in batches:
                _, x, c = _csr(batch)
                all_ += np.bincount(x, c, width).astype(np.int64)
                texts += np.bincount(x, minlength=width)
            yield pa.RecordBatch.from_arrays([pa.array([all_.tobytes()]), pa.array([texts.tobytes()])], names=["a", "t"])

        parts = few(rows.select("_places", "_counts")).mapInArrow(sums, "a binary, t binary").collect()
        totals, texts = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for p in parts:
            totals, texts = totals + np.frombuffer(p["a"], np.int64), texts + np.frombuffer(p["t"], np.int64)
        fit = np.flatnonzero((texts >= low) & (texts <= high) & (totals >= total))
        if len(fit) >= size or total <= low:
            break
        wanted *= 2
    chosen = fit[np.lexsort((codes[fit], -totals[fit]))[:size]]
    idf = np.zeros(width)
    idf[chosen] = np.log((n + 1) / (texts[chosen] + 1))
    return Packed(rows, codes, np.isin(np.arange(width), chosen), idf, n)


class Product:
    """For blocks of sparse rows, the rows times q and the sum of the rows' transpose times that: dense over the columns that a block has."""

    def __init__(self, q: np.ndarray):
        self.q, self.buffer, self.place = q, np.zeros(0, q.dtype), np.zeros(len(q), np.int64)

    def _dense(self, at, x, y):
        """The rows in dense parts, with the columns of each; a part is good until the next one."""
        columns = np.flatnonzero(np.bincount(x, minlength=len(self.q)))
        n, wide = len(at) - 1, len(columns)
        if n > 1 and n * wide > BLOCK:
            m = n // 2
            yield from self._dense(at[: m + 1], x[: at[m]], y[: at[m]])
            yield from self._dense(at[m:] - at[m], x[at[m] :], y[at[m] :])
            return
        if len(self.buffer) < n * wide:
            self.buffer = np.zeros(n * wide, self.q.dtype)
        self.place[columns] = np.arange(wide)
        flat = self.buffer[: n * wide]
        flat.fill(0)
        flat[np.repeat(np.arange(n) * wide, np.diff(at)) + self.place[x]] = y
        yield flat.reshape(n, wide), columns

    def onto(self, at, x, y) -> np.ndarray:
        return np.concatenate([block @ self.q[columns] for block, columns in self._dense(at, x, y)])

    def add(self, to: np.ndarray, at, x, y) -> None:
        """Adds A'A q of these rows to ``to``."""
        for block, columns in self._dense(at, x, y):
            to[columns] += block.T @ (block @ self.q[columns])


def weighted(batch, idf: np.ndarray, kind=np.float32):
    """Blocks of the rows of a batch of ``_places, _counts`` as row bounds, places and unit-length weights (1 + ln count) times ``idf``."""
    at, x, c = _csr(batch)
    idf = idf.astype(kind)
    for a in range(0, len(at) - 1, ROWS):
        bounds = at[a : a + ROWS + 1]
        i = x[bounds[0] : bounds[-1]]
        y = (1 + np.log(c[bounds[0] : bounds[-1]].astype(kind))) * idf[i]
        bounds = bounds - bounds[0]
        ends = np.concatenate([[0], np.cumsum(np.square(y, dtype=np.float64))])
        norm = np.sqrt(ends[bounds[1:]] - ends[bounds[:-1]])
        norm[norm == 0] = 1
        yield bounds, i, (y / np.repeat(norm, np.diff(bounds))).astype(kind)

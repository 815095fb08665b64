"""Problem 6: token ids of a whole corpus by a public byte-level BPE vocabulary.

The encoder keeps an index of pair occurrences: all distinct words of a block
of texts are laid out as one array of symbols, every adjacent pair is entered
under its merge rank with all the positions where it occurs, and the ranks that
are active are applied in ascending order, each to all its positions at once. A
merge touches only the two neighbours of each position; the pairs that arise
there are entered under their own ranks, which are always higher than the one
just applied. The ids equal those of the vocabulary's own library.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value of the vocabulary: how a text is cut into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of distinct words that are merged in one index (about 40 times as much memory).
BLOCK_BYTES = 4 << 20


def vocabulary_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """Where a vocabulary file lies: ``folder``, else ``$TOKENIZERS_DIR``, else /opt/tokenizers."""
    return os.path.join(folder or os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_merges(path: str) -> dict[str, np.ndarray]:
    """The merge table as arrays, one entry a merge; small, and sent to the workers once."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    vocab = model["vocab"]
    byte_ids = np.zeros(256, np.int32)
    for letter, b in _byte_letters().items():
        byte_ids[b] = vocab[letter]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left, right = (np.array([vocab[p[side]] for p in pairs], np.int32) for side in (0, 1))
    merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
    made = {int(m): r for r, m in enumerate(merged)}
    if any(made.get(int(x), -1) >= r for r, pair in enumerate(zip(left, right)) for x in pair):
        raise ValueError("a merge uses a symbol that a later merge makes")
    return {"byte_ids": byte_ids, "left": left, "right": right, "merged": merged, "size": np.int64(max(vocab.values()) + 1)}


def _once(x: np.ndarray) -> np.ndarray:
    """Sorted, each value once (numpy's own function hashes first, which takes many times as long)."""
    x.sort()
    return x[np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1]))]


class PairMerges:
    """Encodes blocks of words with the tables of :func:`load_merges`."""

    def __init__(self, tables: dict[str, np.ndarray]):
        self.byte_ids, self.left, self.right, self.merged = (tables[k] for k in ("byte_ids", "left", "right", "merged"))
        self.size = int(tables["size"])
        keys = self.left.astype(np.int64) * self.size + self.right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        # pairs of single bytes, the bulk of all look-ups, by direct index
        self.bytes_rank = self._search(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)

    def _search(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is none."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, one after the other, and the number of ids of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        ends = np.cumsum(sizes)
        symbol = np.empty(n + 1, np.int32)  # place n stands for "no neighbour"
        symbol[:n], symbol[n] = self.byte_ids[raw], -1
        after = np.arange(1, n + 2, dtype=np.int32)
        before = np.arange(-1, n, dtype=np.int32)
        used = ends[sizes > 0]
        after[used - 1] = n
        before[np.concatenate(([0], used[:-1]))] = n
        at = np.flatnonzero(after[:n] != n).astype(np.int32)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            has = ranks >= 0
            places, ranks = places[has], ranks[has]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for part, rank in zip(np.split(places, cuts), ranks[np.concatenate(([0], cuts))].tolist()):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(heap, rank)

        enter(at, self.bytes_rank[raw[at], raw[np.minimum(at + 1, n - 1)]])
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            p = parts[0] if len(parts) == 1 else _once(np.concatenate(parts))
            a, b = self.left[rank], self.right[rank]
            q = after[p]
            live = (symbol[p] == a) & (symbol[q] == b)
            if not live.all():
                p, q = p[live], q[live]
            if not len(p):
                continue
            if a == b and len(p) > 1:
                # in a run of overlapping pairs every second one goes, from the left
                p.sort()
                q = after[p]
                starts = np.concatenate(([True], q[:-1] != p[1:]))
                first = np.maximum.accumulate(np.where(starts, np.arange(len(p)), 0))
                take = (np.arange(len(p)) - first) % 2 == 0
                p, q = p[take], q[take]
            nn = after[q]
            symbol[p], symbol[q] = self.merged[rank], -2
            after[p] = nn
            before[nn] = p
            pp = before[p]
            places = _once(np.concatenate((pp[pp != n], p[nn != n])))
            enter(places, self._search(symbol[places], symbol[after[places]]))
        keep = symbol[:n] >= 0
        counts = np.zeros(len(words), np.int64)
        kept = np.concatenate(([0], np.cumsum(keep)))
        begins = ends - sizes
        counts = kept[ends] - kept[begins]
        return symbol[:n][keep], counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and the number of ids of each; null and empty texts have none."""
        find = regex.compile(WORDS).findall
        number: dict[str, int] = {}
        flat: list[int] = []
        per_text = np.zeros(len(texts), np.int64)
        out: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        done, load = 0, 0

        def flush(upto: int) -> None:
            nonlocal done, load
            ids, size = self.encode_words([w.encode("utf-8", "replace") for w in number])
            begin = np.cumsum(size) - size
            w = np.array(flat, np.int64)
            length = size[w] if len(w) else np.zeros(0, np.int64)
            total = int(length.sum())
            place = np.repeat(begin[w] - (np.cumsum(length) - length), length) + np.arange(total) if total else np.zeros(0, np.int64)
            out.append(ids[place])
            edge = np.concatenate(([0], np.cumsum(length)))
            upto_word = np.cumsum(per_text[done:upto])
            counts[done:upto] = edge[upto_word] - edge[upto_word - per_text[done:upto]]
            number.clear()
            flat.clear()
            done, load = upto, 0

        for i, text in enumerate(texts):
            if text:
                words = find(text)
                per_text[i] = len(words)
                for w in words:
                    k = number.get(w)
                    if k is None:
                        k = number[w] = len(number)
                        load += 3 * len(w)
                    flat.append(k)
            if load >= BLOCK_BYTES:
                flush(i + 1)
        flush(len(texts))
        return np.concatenate(out) if out else np.zeros(0, np.int32), counts


def _encoder(documents: DataFrame, path: str | None):
    return documents.sparkSession.sparkContext.broadcast(load_merges(path or vocabulary_path()))  # one entry a merge of the vocabulary


def _blocks(batches: Iterator[pa.RecordBatch], least: int = 2 << 20) -> Iterator[pa.Table]:
    """Batches put together until they hold ``least`` bytes, so that each pair index covers many texts."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= least:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def token_ids(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col`` and ``ids`` (array of int), one row per row; null, empty: an empty list. Special tokens' strings are ordinary text."""
    merges = _encoder(documents, path)

    def encode(batches):
        encoder = PairMerges(merges.value)
        for t in _blocks(batches):
            ids, counts = encoder.encode(t.column("_text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32()))
            yield from pa.table({id_col: t.column("_id"), "ids": lists}).to_batches(max_chunksize=4096)

    rows = documents.select(documents[id_col].alias("_id"), documents[text_col].alias("_text"))
    return rows.mapInArrow(encode, f"{id_col} {dict(rows.dtypes)['_id']}, ids array<int>")


def token_counts(documents: DataFrame, *more: str, text_col: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``more`` and ``n_tokens`` of each row, by the same encoder; null and empty texts have 0."""
    merges = _encoder(documents, path)

    def count(batches):
        encoder = PairMerges(merges.value)
        for t in _blocks(batches):
            _, counts = encoder.encode(t.column("_text").to_pylist())
            yield from t.drop_columns(["_text"]).append_column("n_tokens", pa.array(counts, pa.int64())).to_batches()

    rows = documents.select(*more, documents[text_col].alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(count, f"{schema}, n_tokens bigint")

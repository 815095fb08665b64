"""Token shingles as 64-bit hashes, and MinHash over them, a block of texts at a time.

Similarity of two texts: lower-case them; tokens are the longest runs of a-z and
0-9 and the single characters U+4E00..U+9FFF; compare the sets of sequences of
``width`` tokens by Jaccard. A text with fewer tokens has an empty set and is
similar to nothing.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

TOKEN = re.compile("[a-z0-9]+|[一-鿿]")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after another, lower-cased as far as tokens go, and how many each text has."""
    whole = [t or "" for t in texts]
    joined = "".join(whole)
    if "\u0130" in joined or "\u212a" in joined:  # the only others whose lower case has letters of a-z
        whole = [t.lower() for t in whole]
        joined = "".join(whole)
    p = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(p - np.uint32(65) < 26, p | np.uint32(32), p), np.fromiter(map(len, whole), np.int64, len(whole))


#: Kinds of characters: those below SINGLE stand in runs of their kind, each other is a token by itself, 0 separates.
WORD, SINGLE = 1, 128


def kinds(p: np.ndarray) -> np.ndarray:
    """The kinds behind :func:`tokens`."""
    return ((p - np.uint32(97) < 26) | (p - np.uint32(48) < 10)) * np.uint8(WORD) | (p - np.uint32(0x4E00) < 0x5200) * np.uint8(SINGLE)


def token_hashes(p: np.ndarray, lengths: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash and first place of every token of what :func:`points` gives, and how many tokens each text has."""
    kind = kinds(p) if kind is None else kind
    first = np.cumsum(lengths) - lengths
    goes_on = np.zeros(len(p), bool)
    goes_on[1:] = (kind[1:] == kind[:-1]) & (kind[1:] < SINGLE)
    goes_on[first[lengths > 0]] = False
    at = np.flatnonzero(kind)
    begins = np.flatnonzero(~goes_on[at])
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
    place = at[begins]
    offset = np.arange(len(at)) - np.repeat(begins, np.diff(begins, append=len(at)))  # the characters of a token stand together
    z = (p[at].astype(np.uint64) + np.uint64(1)) * _ODD[0] + offset.view(np.uint64) * _ODD[1]
    z = (z ^ (z >> np.uint64(32))) * _ODD[2]
    h = np.add.reduceat(z ^ (z >> np.uint64(29)), begins)
    return h, place, np.diff(np.searchsorted(place, first), append=len(place))


def tokenized(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all texts one after another, and how many tokens each text has."""
    h, _, sizes = token_hashes(*points(texts))
    return h, sizes


def distinct(sorted_keys: np.ndarray) -> np.ndarray:
    """Which of the sorted keys differ from the one before."""
    return np.concatenate((np.ones(min(len(sorted_keys), 1), bool), sorted_keys[1:] != sorted_keys[:-1]))


def windows(hashes: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and start of every sequence of ``width`` tokens; ``sizes`` are the token counts of the texts."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    h = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        h = mix(h ^ hashes[i : n - width + 1 + i] + _ODD[i % len(_ODD)])
    at = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
    return h[at], doc[at], at - begin[at]


def sets(texts: list[str | None], width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of at most 2,048 texts, in order within each, and how many each text has."""
    hashes, sizes = tokenized(texts)
    h, doc, _ = windows(hashes, sizes, width)
    key = np.sort((doc.astype(np.uint64) << np.uint64(53)) | (h >> np.uint64(11)))
    key = key[distinct(key)]
    return mix(key & np.uint64((1 << 53) - 1)), np.bincount((key >> np.uint64(53)).astype(np.int64), minlength=len(texts))


def set_identity(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set: equal sets have equal numbers."""
    total = np.zeros(len(sizes), np.uint64)
    has = sizes > 0
    if has.any():
        total[has] = np.add.reduceat(mix(h + _ODD[0]), (np.cumsum(sizes) - sizes)[has])
    return mix(total + sizes.astype(np.uint64) * _ODD[1])


def minhashes(h: np.ndarray, sizes: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """``count`` minimum hashes of each set, one row a set; sets must not be empty."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    begin = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), count), np.uint64)
    if len(sizes):
        for k, f in enumerate(factors):
            out[:, k] = np.minimum.reduceat(h * f, begin)
    return out


def fingerprint(minimums: np.ndarray, bits: int = 2) -> np.ndarray:
    """``bits`` bits of each minimum hash, as at least three 64-bit words (one row a set): each bit differs with probability (1 - Jaccard) / 2."""
    z = mix(minimums + _ODD[2])
    taken = np.concatenate([((z >> np.uint64(63 - b)) & np.uint64(1)).astype(np.uint8) for b in range(bits)], axis=1)
    width = max(192, taken.shape[1] + -taken.shape[1] % 64)
    return np.packbits(np.pad(taken, ((0, 0), (0, width - taken.shape[1]))), axis=1).view(np.uint64)


def radius(count: int, similarity: float, bits: int = 2, deviations: float = 5.0) -> int:
    """The Hamming distance of fingerprints of ``count`` minimum hashes that pairs of this similarity exceed about three times in ten million."""
    d = 1 - similarity
    variance = d * (bits / 4 + bits * bits / 4) - (d * bits / 2) ** 2
    return int(count * d * bits / 2 + deviations * (count * variance) ** 0.5)


def held(wanted: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of the numbers ``wanted`` are ``among`` others."""
    out = np.zeros(len(wanted), bool)
    if len(among):
        mark = np.zeros(1 << 20, bool)
        mark[among >> np.uint64(44)] = True
        maybe = np.flatnonzero(mark[wanted >> np.uint64(44)])
        among = np.sort(among)
        out[maybe] = among[np.minimum(np.searchsorted(among, wanted[maybe]), len(among) - 1)] == wanted[maybe]
    return out

"""Problem 8: text statistics per document, and what kind of text they tell: prose, list, table or junk.

Gradient-boosted trees over the statistics decide. They are fitted on a bounded
sample of rows that rules label (a quarter of all rows get no label), and their
probabilities are calibrated on the hand-checked texts of
:mod:`dialoom.llm.quality_holdout`. The statistics cover every document whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm import quality_holdout
from dialoom.llm.boosting import Boosted
from dialoom.llm.shingles import distinct, mix, points, token_hashes
from dialoom.session import durable

KINDS = ("prose", "list", "table", "junk")
#: Most weakly labelled rows of each kind that the trees are fitted on.
SAMPLE_PER_KIND = 1500

#: Function words of English and Spanish, and characters that running Chinese text is full of.
COMMON = frozenset(
    "the and of to in is that for with it on a an be you or if at not are was but by as this when who before more most than would may can has have from about what how do does your my their its one two out up so"
    " el la los las de del que y en un una por con para se su al es no si como más lo le pero muy o cada antes sin cuando".split()
)
COMMON_HAN = frozenset("的是了不在有和要就可以我您也这那到去再先会都还很把被让对从与或但如果一上下时后前来看等只因所为着过么吗呢")
NAVIGATION = frozenset("home login logout cart share rss cookie settings register next previous more menu search contact about help sitemap privacy terms copyright subscribe 首页 登录 注册 收藏 举报 联系 返回顶部 下一页 上一页 关于本站 点击展开全文 更多 版权所有 分享 评论 搜索 购物车 导航".split()) | {"cookie settings", "more...", "©", "»", ">>", "<<"}
BULLET = re.compile(r"\s*(?:[-*•·▪◦‣+–—]\s|\[[ xX]\]|(?:[（(]?(?:\d{1,3}|[一二三四五六七八九十]{1,3}|[a-zA-Z])[)）.、．:：]))\s*")
TERMINAL = re.compile(r"[。！？!?…]|(?<=[^\W\d_])[.](?=\s|$|[\"')）”])|(?<=\d)[.](?=\s+[A-ZÁÉÍÓÚ¿¡]|$)|(?<=[)）%”\"])[.](?=\s|$)")
WORD = re.compile(r"[^\W\d_]+", re.U)
HAN = re.compile("[一-鿿㐀-䶿]")
HAN_RUN = re.compile("[一-鿿㐀-䶿]+")
LINES = re.compile("\r\n|[\r\n  \x0b\x0c]")
VOWELS = re.compile("[aeiouyáéíóúü]+", re.I)
LONG_RUN = re.compile(r"[!-~]{28,}")
HEX_LINE = re.compile(r"^\s*(?:[0-9a-fA-F]{6,}[:：]\s)?(?:[0-9a-fA-F]{2,4}[ \t]+){6,}")

FEATURES = (
    "n_chars n_words n_lines mean_word_length mean_line_length line_length_spread symbol_ratio digit_ratio space_ratio upper_ratio han_ratio punctuated_lines bullet_lines short_lines sentence_rate sentences_per_line"
    " words_per_sentence common_share field_lines field_agreement html_cells comma_fields wide_gaps odd_latin replacement_ratio long_run_share hex_lines vowel_shape unusual_words navigation_share distinct_lines distinct_pairs compressed top_char mean_item_words numeric_fields han_run kinds_of_pairs han_order latin_order"
).split()


#: Buckets of the counts of adjacent letters; the counts cover all documents and stay this small at any size.
PAIR_BUCKETS, LETTER_BUCKETS = 1 << 18, 1 << 16


def _adjacent(points: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each pair of adjacent letters of a text, the two letters and the number of the text; a pair is within one script."""
    han = points - np.uint32(0x3400) <= 0x9FFF - 0x3400
    low = points | np.uint32(32)
    latin = (low - np.uint32(97) < 26) | (points - np.uint32(0xC0) < 0x250 - 0xC0)
    script = han.view(np.uint8) + latin.view(np.uint8) * np.uint8(2)
    at = np.flatnonzero((script[:-1] > 0) & (script[:-1] == script[1:]) & (doc[:-1] == doc[1:]))
    points = np.where(latin, low, points).astype(np.uint64)
    a, b = points[at], points[at + 1]
    return (mix(a << np.uint64(21) | b) & np.uint64(PAIR_BUCKETS - 1)).astype(np.int64), a, b, doc[at]


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after another, and the number of the text of each."""
    p = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return p, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def letter_counts(documents: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all documents: counts of adjacent letters, of first and of second letters, in buckets of fixed number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, first, second = np.zeros(PAIR_BUCKETS, np.int64), np.zeros(LETTER_BUCKETS, np.int64), np.zeros(LETTER_BUCKETS, np.int64)
        mask = np.uint64(LETTER_BUCKETS - 1)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                k, a, b, _ = _adjacent(*_points([t for t in part.column(0).to_pylist() if t]))
                pairs += np.bincount(k, minlength=PAIR_BUCKETS)
                first += np.bincount((a & mask).astype(np.int64), minlength=LETTER_BUCKETS)
                second += np.bincount((b & mask).astype(np.int64), minlength=LETTER_BUCKETS)
        for which, found in enumerate((pairs, first, second)):
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), which, np.int32)), pa.array(at.astype(np.int32)), pa.array(found[at])], names=["which", "bucket", "n"])

    rows = documents.select(documents[text_col].alias("_text")).mapInArrow(count, "which int, bucket int, n bigint").groupBy("which", "bucket").agg(F.sum("n").alias("n")).toPandas()
    out = []
    for which, size in enumerate((PAIR_BUCKETS, LETTER_BUCKETS, LETTER_BUCKETS)):
        part = rows[rows["which"] == which]
        table = np.zeros(size, np.int64)
        table[part["bucket"].to_numpy()] = part["n"].to_numpy()
        out.append(table)
    return tuple(out)


def _order(points: np.ndarray, doc: np.ndarray, n: int, known: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """How much more often than by chance the adjacent letters of each text stand together in the corpus (mean log ratio), for Han and for Latin."""
    han_order, latin_order = np.full(n, 4.0), np.full(n, 1.0)
    if known is None:
        return han_order, latin_order
    k, a, b, of = _adjacent(points, doc)
    pairs, first, second = known
    mask = np.uint64(LETTER_BUCKETS - 1)
    value = np.log((pairs[k] + 0.05) * max(float(pairs.sum()), 1.0)) - np.log((first[(a & mask).astype(np.int64)] + 1.0) * (second[(b & mask).astype(np.int64)] + 1.0))
    han = a >= 0x3400
    for out, use, least in ((han_order, han, 8), (latin_order, ~han, 20)):
        count = np.bincount(of[use], minlength=n)
        has = count >= least
        out[has] = (np.bincount(of[use], value[use], n) / np.maximum(count, 1))[has]
    return han_order, latin_order


#: Classes of characters, one bit each, for the Basic Multilingual Plane; others are looked up one by one.
SPACE, LETTER, DIGIT, UPPER, WORDLY, HAN_LETTER, COMMON_LETTER, ODD, VOWEL, CONSONANT = (1 << i for i in range(10))


def _class(c: str) -> int:
    low = c.lower()
    bits = ((SPACE, c.isspace()), (LETTER, c.isalpha()), (DIGIT, c.isdigit()), (UPPER, c.isupper()), (WORDLY, bool(WORD.match(c))), (HAN_LETTER, bool(HAN.match(c))), (COMMON_LETTER, c in COMMON_HAN))
    more = ((ODD, "\x80" <= c <= "ÿ" and c not in "áéíóúüñÁÉÍÓÚÜÑ¿¡°·×±²³µ«»©"), (VOWEL, low in "aeiouyáéíóúü"), (CONSONANT, low in "bcdfghjklmnpqrstvwxz"))
    return sum(bit for bit, has in (*bits, *more) if has)


_CLASSES: list[np.ndarray] = []


def _classes(points: np.ndarray) -> np.ndarray:
    if not _CLASSES:
        _CLASSES.append(np.array([_class(chr(c)) for c in range(0x10000)], np.uint16))
    out = _CLASSES[0][np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        values = np.sort(points[far])
        values = values[distinct(values)]
        out[far] = np.array([_class(chr(c)) for c in values.tolist()], np.uint16)[np.searchsorted(values, points[far])]
    return out


def _common_words() -> np.ndarray:
    p, lengths = points(sorted(COMMON))
    return np.sort(token_hashes(p, lengths, np.ones(len(p), np.uint8))[0])


_TERMINALS, _PUNCTUATED, _HEX_LINES = re.compile(TERMINAL.pattern, re.M), re.compile(r"[。！？!?.…][\"'”’)）」]*$", re.M), re.compile(HEX_LINE.pattern.replace(r"\s*", r"[^\S\n]*"), re.M)
_BLANKS, _WIDE, _ITEMS, _NUMERIC = re.compile(r"\s{2,}"), re.compile(r"\S\s{2,}\S"), re.compile(r"\s*[|»>·\t]+\s*|\s{2,}"), re.compile(r"\s*[-+]?\d[\d.,:/%-]*\s*")
_COLUMNS, _CELLS, _MAY_HEX = re.compile(r"\S\s{2,}\S+.*\s{2,}\S"), re.compile(r"</?t[dhr]\b", re.I), re.compile(r"[0-9a-fA-F]{2}[ \t]")


def _layout(text: str) -> tuple:
    """What the lines of a text tell."""
    lines = [x for x in map(str.strip, LINES.split(text)) if x]
    m = max(len(lines), 1)
    bullets = [BULLET.match(x) for x in lines]
    body = [BULLET.sub("", x, count=1) if b else x for x, b in zip(lines, bullets)]
    han = [len(HAN.findall(x)) for x in lines]
    lengths = np.array([len(x) + k for x, k in zip(lines, han)] or [0], float)  # a Han character is two columns wide
    joined = "\n".join(body)
    sentences = len(_TERMINALS.findall(joined))
    fields: Counter = Counter()
    agreement = 0.0
    numeric = cells = 0
    wide = any(_BLANKS.search(x) for x in lines) if "  " in text or any(x in text for x in "\t\u3000\xa0") or _BLANKS.search(joined) else False
    for mark in ("|", "│", "\t", ";", "；", ",", "，", "  "):
        if not (wide if mark == "  " else mark in text):
            continue
        per = [len(_BLANKS.findall(x)) if mark == "  " else x.count(mark) for x in body]
        most = Counter(k for k in per if k >= (2 if mark in ";；,，" else 1))
        if most:
            k, rows = most.most_common(1)[0]
            share = rows / m
            if share > agreement and m >= 2:
                agreement = share
                fields[mark] = rows
                split = [_BLANKS.split(x) if mark == "  " else x.split(mark) for x in body]
                cells = sum(map(len, split))
                numeric = sum(c[:1] not in ALPHABET and bool(_NUMERIC.fullmatch(c)) for row in split for c in row)
    barred = any(k in text for k in "|│\t")
    field_lines = sum(barred and any(x.count(k) >= 2 for k in "|│\t") or x.count(",") - x.count(", ") >= 2 or wide and bool(_COLUMNS.search(x)) for x in lines) / m if barred or wide or "," in text else 0.0
    html = len(_CELLS.findall(text)) if "<" in text else 0
    hexed = len(_HEX_LINES.findall("\n".join(lines))) / m if _MAY_HEX.search(text) else 0.0
    parted = wide or any(k in text for k in "|»>·\t")
    items = [y for x in lines for y in map(str.strip, _ITEMS.split(x)) if y] if parted else lines
    navigation = sum(y.lower() in NAVIGATION for y in items) / max(len(items), 1)
    body_words = [(k if not b else len(HAN.findall(x))) / 2 + (sum(1 for w in WORD.findall(x) if not HAN.match(w)) if not x.isalpha() or k < len(x) else 0) for x, k, b in zip(body, han, bullets)]
    gaps = sum(bool(_WIDE.search(x)) for x in lines) / m if wide else 0.0
    mean = float(lengths.mean())
    return (
        len(lines), mean, float(lengths.std() / max(mean, 1)), len(_PUNCTUATED.findall(joined)) / m, sum(b is not None for b in bullets) / m, float((lengths < 44).mean()) if lines else 0.0, sentences,
        field_lines, agreement, html / m, fields[","] / m, gaps, hexed, navigation, len(set(lines)) / m, sum(body_words) / max(len(body_words), 1), numeric / max(cells, 1),
    )


ALPHABET = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def statistics_of(texts: list[str], known: tuple | None = None) -> np.ndarray:
    """The statistics of texts that are not blank, one row each, in the order of FEATURES; ``known`` is the result of :func:`letter_counts`."""
    count = len(texts)
    out = np.zeros((count, len(FEATURES)))
    if not count:
        return out
    p, doc = _points(texts)
    kind = _classes(p)
    ends = np.cumsum([len(t) for t in texts])
    n = np.diff(ends, prepend=0)

    def per_text(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(mask)))
        return upto[ends] - upto[ends - n]

    of = lambda bit: (kind & bit).astype(bool)
    dense = n - per_text(of(SPACE))
    letters, digits, upper, han = (per_text(of(b)) for b in (LETTER, DIGIT, UPPER, HAN_LETTER))
    some = np.maximum(dense, 1)
    # words of other scripts than Han: runs of letters that do not begin with a Han character
    low = np.where((p - np.uint32(65) < 26) | (p - np.uint32(0xC0) < 31) & (p != 0xD7), p + np.uint32(32), p)
    h, place, sizes = token_hashes(low, n, of(WORDLY).astype(np.uint8))
    word_doc = np.repeat(np.arange(count), sizes)
    length = np.zeros(len(place), np.int64)
    if len(place):
        wordly = np.concatenate(([0], np.cumsum(of(WORDLY))))
        length = wordly[np.append(place[1:], len(p))] - wordly[place]
    latin = ~of(HAN_LETTER)[place]
    h, place, word_doc, length = h[latin], place[latin], word_doc[latin], length[latin]
    n_latin = np.bincount(word_doc, minlength=count)
    words = n_latin + han
    at = np.minimum(np.searchsorted(_COMMON_HASHES, h), len(_COMMON_HASHES) - 1)
    common = np.bincount(word_doc, _COMMON_HASHES[at] == h, count) + per_text(of(COMMON_LETTER))
    longer = length > 2
    first, last, size, owner = place[longer], place[longer] + length[longer], length[longer], word_doc[longer]
    inside = lambda mask: (upto := np.concatenate(([0], np.cumsum(mask))))[last] - upto[first]
    vowel, consonant = of(VOWEL), of(CONSONANT)
    runs = inside(vowel & ~np.concatenate(([False], vowel[:-1]))) + (vowel[first] & np.concatenate(([False], vowel[:-1]))[first])
    heavy = np.zeros(len(p), bool)
    heavy[3:] = consonant[3:] & consonant[2:-1] & consonant[1:-2] & consonant[:-3]
    upto = np.concatenate(([0], np.cumsum(heavy)))
    four = upto[last] - upto[np.minimum(first + 3, last)] > 0
    lone_q = inside((low == 113) & (np.concatenate((low[1:], [0])) != 117)) + ((low[last - 1] == 113) & (np.concatenate((low, [0]))[last] == 117))
    unusual = four | (inside(consonant) == size) | (lone_q > 0)
    n_longer = np.bincount(owner, minlength=count)
    vowels = np.where(n_longer > 0, np.bincount(owner, runs / np.maximum(size, 1), count) / np.maximum(n_longer, 1), 0.35)
    # the most frequent character, and different pairs of adjacent characters
    key = np.sort((doc.astype(np.uint64) << np.uint64(21) | p)[~of(SPACE)])
    top = np.zeros(count, np.int64)
    if len(key):
        edge = np.flatnonzero(distinct(key))
        np.maximum.at(top, (key[edge] >> np.uint64(21)).astype(np.int64), np.diff(edge, append=len(key)))
    near = doc[:-1] == doc[1:]
    key = np.sort(((doc[:-1].astype(np.uint64) << np.uint64(21) | p[:-1]) << np.uint64(21) | p[1:])[near])
    pairs = np.bincount((key[distinct(key)] >> np.uint64(42)).astype(np.int64), minlength=count)
    pairs = np.where(n > 1, pairs, 1)
    run = per_text(of(HAN_LETTER) & ~np.concatenate(([False], of(HAN_LETTER)[:-1] & near)))
    marks = {c: per_text(p == ord(c)) for c in "�□¿．·"}
    han_order, latin_order = _order(p, doc, count, known)
    columns = {
        "n_chars": n, "n_words": words, "mean_word_length": np.bincount(word_doc, length, count) / np.maximum(n_latin, 1), "symbol_ratio": (dense - letters - digits) / some, "digit_ratio": digits / some, "space_ratio": (n - dense) / np.maximum(n, 1),
        "upper_ratio": upper / np.maximum(letters, 1), "han_ratio": han / some, "common_share": common / np.maximum(words, 1), "odd_latin": per_text(of(ODD)) / some, "vowel_shape": vowels, "unusual_words": np.bincount(owner, unusual, count) / np.maximum(n_longer, 1),
        "distinct_pairs": pairs / np.maximum(n - 1, 1), "top_char": top / some, "han_run": np.where(han > 0, han / np.maximum(run, 1), 8.0), "kinds_of_pairs": np.minimum(pairs, 500), "han_order": han_order, "latin_order": latin_order,
    }
    for name, values in columns.items():
        out[:, _AT[name]] = values
    layout = [_AT[f] for f in "n_lines mean_line_length line_length_spread punctuated_lines bullet_lines short_lines sentences_per_line field_lines field_agreement html_cells comma_fields wide_gaps hex_lines navigation_share distinct_lines mean_item_words numeric_fields".split()]
    for i, text in enumerate(texts):
        out[i, layout] = _layout(text)
        inverted = marks["¿"][i] and (marks["¿"][i] > 2 * text.count("¿ ") and "?" not in text or marks["¿"][i] / some[i] > 0.03)
        out[i, _AT["replacement_ratio"]] = (marks["�"][i] + marks["□"][i] + marks["¿"][i] * bool(inverted) + marks["．"][i] + marks["·"][i]) / some[i]
        out[i, _AT["long_run_share"]] = sum(map(len, LONG_RUN.findall(text))) / max(n[i], 1)
        raw = text.encode("utf-8", "replace")
        out[i, _AT["compressed"]] = len(zlib.compress(raw, 1)) / max(len(raw), 1)
    sentences = out[:, _AT["sentences_per_line"]].copy()
    lines = np.maximum(out[:, _AT["n_lines"]], 1)
    out[:, _AT["sentence_rate"]] = 100 * sentences / np.maximum(words, 1)
    out[:, _AT["words_per_sentence"]] = words / np.maximum(sentences, 1)
    out[:, _AT["sentences_per_line"]] = sentences / lines
    return out


def statistics(text: str, known: tuple | None = None) -> list[float]:
    """The statistics of one text, see :func:`statistics_of`."""
    return statistics_of([text], known)[0].tolist()


_AT = {name: i for i, name in enumerate(FEATURES)}
_COMMON_HASHES = _common_words()


#: Below these mean log ratios adjacent letters stand in hardly more than random order.
HAN_CHANCE, LATIN_CHANCE = 2.0, 0.45
#: Above these they stand in the order of the corpus.
HAN_ORDER, LATIN_ORDER = 3.2, 1.0


def weak_label(x: list[float]) -> int:
    """The number of the kind that rules are sure of, or -1. Prose is only named where it is clean: no odd characters, few bullets, letters in the order of the corpus."""
    v = {k: x[i] for k, i in _AT.items()}
    if v["odd_latin"] > 0.15 or v["replacement_ratio"] > 0.15 or v["hex_lines"] > 0.6 or v["navigation_share"] > 0.5 and v["n_words"] > 6:
        return 3
    if v["html_cells"] > 0.9 and v["html_cells"] * v["n_lines"] > 5 or v["n_lines"] >= 3 and v["sentence_rate"] < 3 and v["field_agreement"] > 0.7 and (v["field_lines"] > 0.6 or v["numeric_fields"] > 0.3):
        return 2
    if v["n_chars"] > 40 and (v["kinds_of_pairs"] <= 14 or v["top_char"] > 0.5 or v["compressed"] < 0.06 and v["distinct_lines"] < 0.3):
        return 3
    if v["han_order"] < HAN_CHANCE and v["han_ratio"] > 0.3 or v["latin_order"] < LATIN_CHANCE and v["han_ratio"] < 0.2 and v["n_words"] > 12:
        return 3
    if v["han_run"] < 1.7 and v["han_ratio"] > 0.3 and v["n_chars"] > 40 or v["mean_word_length"] < 2 and v["han_ratio"] < 0.05 and v["n_words"] > 30:
        return 3
    if v["long_run_share"] > 0.6 and v["han_ratio"] < 0.05:
        return 3
    if v["n_words"] > 15 and v["han_ratio"] < 0.05 and v["common_share"] < 0.03 and v["unusual_words"] > 0.25 and v["n_lines"] < 4:
        return 3
    if v["n_lines"] >= 4 and v["short_lines"] > 0.9 and v["sentences_per_line"] < 0.15 and v["field_agreement"] < 0.5 and v["mean_item_words"] < 7 and v["words_per_sentence"] > 15 and v["distinct_lines"] > 0.5 and v["navigation_share"] < 0.1:
        return 1
    ordered = v["han_order"] > HAN_ORDER if v["han_ratio"] > 0.3 else v["latin_order"] > LATIN_ORDER
    if not ordered or v["replacement_ratio"] > 0 or v["odd_latin"] > 0 or v["bullet_lines"] >= 0.3:
        return -1
    if v["common_share"] > 0.08 and 1 <= v["sentence_rate"] <= 14 and v["words_per_sentence"] < 45 and v["sentences_per_line"] > 0.35 and v["replacement_ratio"] < 0.02 and v["odd_latin"] < 0.02 and v["field_lines"] < 0.5:
        return 0
    return -1


def measured(documents: DataFrame, known: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the columns FEATURES and ``weak`` (see :func:`weak_label`) of every document that is not null or blank."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                kept = [(i, t) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if t and t.strip("﻿​ \t\r\n") and not t.isspace()]
                table = statistics_of([t for _, t in kept], letters.value)
                weak = pa.array([weak_label(r) for r in table.tolist()], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept], part.schema.field(0).type), *[pa.array(table[:, i]) for i in range(len(FEATURES))], weak], names=[id_col, *FEATURES, "weak"])

    rows = documents.select(documents[id_col].alias(id_col), documents[text_col].alias("_text"))
    letters = documents.sparkSession.sparkContext.broadcast(known)  # tables of fixed size
    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(measure, f"`{id_col}` {kind}, " + ", ".join(f"`{f}` double" for f in FEATURES) + ", weak int")


def fitted(stats: DataFrame, known: tuple, id_col: str = "doc_id") -> Boosted:
    """The trees, fitted on at most SAMPLE_PER_KIND weakly labelled rows of each kind (lowest hashes of the identifier) and calibrated by hand-checked texts."""
    x, y = [], []
    for kind in range(len(KINDS)):
        sample = stats.where(F.col("weak") == kind).orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(SAMPLE_PER_KIND).select(*FEATURES).toPandas()
        x.append(sample.to_numpy(float))
        y.append(np.full(len(sample), kind))
    model = Boosted(len(KINDS)).fit(np.concatenate(x), np.concatenate(y))
    texts, kinds = quality_holdout.texts()
    return model.calibrate(statistics_of(texts, known), np.array([KINDS.index(k) for k in kinds]))


def judged(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every statistic of each document with ``kind`` and the calibrated ``p_prose, p_list, p_table, p_junk``.

    Null, empty and blank texts have no row; with no weakly labelled row at all
    (an empty table, say) there is no model and no row.
    """
    known = letter_counts(documents, text_col)
    stats = durable(measured(documents, known, id_col, text_col))
    spark = documents.sparkSession
    names = [f"p_{k}" for k in KINDS]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema if f.name != "weak") + ", kind string, " + ", ".join(f"{p} double" for p in names)
    if stats.where("weak >= 0").isEmpty():
        return spark.createDataFrame([], schema)
    model = spark.sparkContext.broadcast(vars(fitted(stats, known, id_col)))  # a few hundred small trees

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Boosted(len(KINDS))
        vars(trees).update(model.value)
        for batch in batches:
            p = trees.probabilities(np.stack([batch.column(f).to_numpy() for f in FEATURES], 1)) if batch.num_rows else np.zeros((0, len(KINDS)))
            kinds = pa.array([KINDS[k] for k in p.argmax(1)], pa.string())
            own = [batch.column(f) for f in (id_col, *FEATURES)]
            yield pa.RecordBatch.from_arrays([*own, kinds, *[pa.array(p[:, i]) for i in range(len(KINDS))]], names=[id_col, *FEATURES, "kind", *names])

    return stats.mapInArrow(judge, schema)


def found(documents: DataFrame) -> DataFrame:
    """``doc_id, kind`` of the documents that are mostly a list, a table or junk."""
    return judged(documents).where("kind <> 'prose'").select("doc_id", "kind")

"""Problem 3: answers that are no usable answer to their question.

One pass looks at each answer beside its question: empty or placeholder, copy of
the question (share of the answer's shingles that the question has), language
(scripts, and function words of the languages in Latin letters), wording that
declines, and how the text ends. What one answer cannot tell is learnt from all:

* Refusals. Numbers, and words taken from the question, are masked in each
  clause, so that a template is the same clause under every question. A clause
  that recurs over different questions, mostly in answers that decline, is part
  of a refusal template; answers made of such clauses are refusals as well, and
  what else recurs mostly in them joins the templates. So wordings are found that
  no list has. The openings (first clause of five tokens) are clustered by
  MinHash, verified at a similarity of 0.8 of their five-token shingles; a cluster
  that recurs over different questions and mostly declines is a template too.
* Endings. A text without a final mark is finished if its last tokens mostly end a
  sentence wherever else they stand in the corpus; those counts cover all answers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm import neardup, shingles
from dialoom.session import durable

#: Letters that remain of a placeholder once marks, blanks and tags are gone.
PLACEHOLDERS = frozenset("null none nan na tbd todo nil empty blank undefined missing placeholder noanswer nocontent 无 空 略 暂无 没有 待补充 待定 待填 待填写 未填写 无内容 无回答 暂无回答 暂无内容 暂缺 空白".split())
#: Wording that declines to answer.
DECLINES = re.compile(
    r"无法回答|不能回答|无法作答|恕不|恕我|不便(?:评论|回答|作答|讨论|提供)|没有办法(?:就|回答|给出|提供)|没有资格|不能(?:给出|提供)[^。]{0,8}(?:意见|建议)|无法(?:给出|提供)[^。]{0,8}(?:意见|建议|帮助)|帮不了您|暂不处理|不予(?:回答|处理)|拒绝回答|无可奉告"
    r"|can(?:'|no|’)?t (?:help|assist|answer|comment|discuss|provide|give|offer|respond)|cannot (?:help|assist|answer|comment|discuss|provide|give|offer|respond)|won(?:'|’)t (?:comment|answer|discuss|be able)|unable to (?:help|assist|answer|comment|discuss|provide|give)|not able to (?:help|assist|answer|comment|discuss|provide|give)"
    r"|must decline|have to decline|i decline|not (?:allowed|permitted|qualified) to|against (?:my|our|the) (?:policy|guidelines|rules)|outside (?:what|the scope)|refuse to",
    re.I,
)
#: A decline followed by help is none.
HELPS = re.compile(r"(?:不过|但是?|然而)[^。]{0,6}(?:可以|能|先)|\bbut (?:i can(?!no|'|’)|here|we can|it|a|an|the|in)\b", re.I)
ASKS = (("en", re.compile(r"用英[文语]|in english", re.I)), ("zh", re.compile(r"用中文|用汉语|in chinese", re.I)), ("es", re.compile(r"西班牙[文语]|in spanish|en español", re.I)))
#: Scripts by their code points; the Latin script counts by words, the others by characters.
SCRIPTS = (("zh", 0x4E00, 0x9FFF), ("zh", 0x3400, 0x4DBF), ("ja", 0x3041, 0x30FF), ("ko", 0xAC00, 0xD7A3), ("ru", 0x400, 0x52F), ("el", 0x370, 0x3FF), ("ar", 0x600, 0x6FF), ("he", 0x590, 0x5FF), ("hi", 0x900, 0x97F), ("th", 0xE01, 0xE5B))
#: Frequent function words of the languages in Latin letters that are told apart.
FUNCTION_WORDS = {
    "en": "the and of to in is that for with it on a an be you or if at not are",
    "es": "el la los las de del que y en un una por con para se su al es no si como más",
    "fr": "le la les des du et est une dans pour que qui sur pas vous avec il ce au si",
    "de": "der die das und ist nicht ein eine zu den mit von sie es auf für im bei wenn oder",
    "pt": "o os as da do em um uma não com para se por mais ao são ou você na no",
    "it": "il lo gli di che è un per non con del della si ma se sono alla una nel ha",
}
TERMINAL = "。．.!！?？"
CONNECT = "，、：；,:;-—–－~～（(［[「『“‘《<&/+=*#"
_CLOSERS = "\"'”’」』》】）)]］"
#: Closing words that are often left without a final mark.
CLOSINGS = re.compile(r"^(?:take care|all the best|best wishes|kind regards|wishing you .*|祝您?.*|愿您?.*|多保重.*|希望能帮到.*|有变化随时.*|谢谢.*|以上供参考)$", re.I | re.S)
MARKS = re.compile(r"\s*(?:^|\n)\s*(?:[-*•·]|[（(]?\d{1,3}\s*[.、)）．:：])\s*$")
#: A template stands under at least so many different questions, and at least this share of its answers decline.
LEAST_QUESTIONS, DECLINED_SHARE = 5, 0.5
#: The shares of the rounds of learning: the first only has the answers whose wording declines, which may be few of all.
SHARES, LEAST_DECLINING = (0.1, 0.5), 3
#: Tokens of an opening's shingles, and the similarity of openings of one cluster.
OPENING_WIDTH, OPENING_SIMILARITY = 5, 0.8
#: Share of a context's occurrences elsewhere that end a sentence, from which a text that stops there is finished.
ENDS_SHARE = 0.25
COPY_SHARE = 0.6

#: Parts of which every wording of DECLINES has one.
DECLINING = "无法 不能 恕 不便 没有办法 没有资格 帮不了 暂不处理 不予 拒绝回答 无可奉告 can't cant can’t cannot won't won’t unable able decline allowed permitted qualified against outside refuse canno".split()
#: What sounds like advice, sending the asker elsewhere aside.
ADVISES = re.compile(r"建议(?!您?(?:直接)?(?:前往|咨询|就医|联系|到))|推荐|试试|应当|最好|注意|\b(?:should|try(?! a different)|drink|take (?!care)|keep|avoid|apply|start with)\b", re.I)
_SENTENCE = re.compile(r"[^。！？!?\n.]+")
_BREAK = re.compile(r"[。！？!?\n]|\.(?=\s|[一-鿿])")
_KINDS = np.zeros(0x10000, np.uint8)  # of the characters of clauses: letters, digits, Han by the character, marks that end a clause
_KINDS[97:123], _KINDS[48:58], _KINDS[0x4E00:0xA000] = 1, 2, shingles.SINGLE
_CLAUSE_MARKS = np.array([ord(c) for c in "，。！？!?;；:：,、\n\r…“”\"「」"], np.uint32)
_SENTENCE_MARKS = np.array([ord(c) for c in "。！？!?\n…"], np.uint32)
_NUMBER, _TAKEN, _MARK = (np.uint64(shingles.xxhash.xxh64_intdigest(x)) for x in ("number", "taken", "^"))


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    rest = re.sub(r"[\W_]+", "", re.sub(r"<[^<>]{0,60}>", "", text)).lower()
    return not rest or rest in PLACEHOLDERS


_LONGEST = max(map(len, PLACEHOLDERS))


def _may_be_empty(text: str, tokens: int) -> bool:
    """False only where :func:`is_empty` is: more tokens than a placeholder has letters, and none of them in a tag."""
    return tokens <= _LONGEST or "<" in text


def declines(text: str) -> tuple[bool, bool, int]:
    """Whether the wording declines, whether it does within the first two sentences, and how many other sentences sound like advice."""
    low = text.lower()
    if not any(x in low for x in DECLINING) or not DECLINES.search(text) or HELPS.search(text):
        return False, False, 0
    said = [bool(DECLINES.search(x)) for x in _SENTENCE.findall(text)]
    return True, any(said[:2]), sum(bool(ADVISES.search(x)) and not d for x, d in zip(_SENTENCE.findall(text), said))


def ending(text: str) -> tuple[str, str]:
    """How a text ends: ("done" | "broken" | "open", the text up to where its last tokens are to be judged)."""
    t = text.rstrip().rstrip("\u200b\ufeff \n\r\t\u3000\xa0")
    last = t[t.rfind("\n") + 1 :]
    if MARKS.match("\n" + last):
        return "broken", ""
    n = len(t)
    while n and not (t[n - 1].isalnum() or t[n - 1] == "_" or t[n - 1].isspace() or t[n - 1] in _KEPT):  # emoji and the like
        n -= 1
    bare = (t[:n] if n < len(t) else t).rstrip()
    n = len(bare)
    while n and bare[n - 1] in "….。":
        n -= 1
    tail = bare[n:]
    if tail and (tail[-1] == "…" or len(tail) > 1 and tail[-1] == tail[-2]):
        return "open", bare[:n]
    bare_closed = bare.rstrip(_CLOSERS)
    if bare != bare_closed and bare[-1] in "）)]】］" or bare_closed[-1:] in TERMINAL and bare_closed[-1:]:
        return "done", ""
    if bare_closed[-1:] and bare_closed[-1] in CONNECT:
        return "broken", ""
    if CLOSINGS.match(_BREAK.split(bare_closed)[-1].strip()):
        return "done", ""
    return "open", bare_closed


_KEPT = frozenset("。．.!！?？，、：；,:;…-—–()（）\"'”’「」『』《》【】[]<>/&+=*#~～")


def _table(points: np.ndarray) -> np.ndarray:
    return np.where(points < 0x10000, points, 0)


def _stops(p: np.ndarray, lengths: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Places of ``marks``, and of full stops that stand before a blank, a Han character or the end of a text."""
    dot = p == 46
    after = np.concatenate((p[1:], [np.uint32(10)])) if len(p) else p
    after[(np.cumsum(lengths) - 1)[lengths > 0]] = 10
    wide = (after <= 32) | (after == 0xA0) | (after == 0x3000) | (after - np.uint32(0x4E00) < 0x5200)
    return np.isin(p, marks) | dot & wide


def contexts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every token of the texts: the hash of the last three tokens of its sentence, whether it ends the sentence, and the number of its text.

    Numbers are masked, and a mark stands where the sentence begins.
    """
    p, lengths = shingles.points(texts)
    kind = _KINDS[_table(p)]
    stop = _stops(p, lengths, _SENTENCE_MARKS)
    point = np.zeros(len(p), bool)  # the point within a number
    point[1:-1] = (p[1:-1] == 46) & (kind[2:] == 2) & (kind[:-2] == 2) & ~stop[1:-1]
    kind[point] = 2
    h, place, sizes = shingles.token_hashes(p, lengths, kind)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    h = np.where(kind[place] == 2, _NUMBER, h)
    sentence = np.cumsum(stop)[place]
    new = np.concatenate(([True], (sentence[1:] != sentence[:-1]) | (doc[1:] != doc[:-1])))
    nth = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    b = np.where(nth >= 1, np.roll(h, 1), _MARK)
    a = np.where(nth >= 2, np.roll(h, 2), _MARK)
    ends = np.concatenate((new[1:], [True]))
    return shingles.mix(shingles.mix(shingles.mix(a) + b) + h), ends, doc


def _unfinished(texts: list[str]) -> list[int | None]:
    """The last context of each text, None where a sentence has just ended."""
    h, _, doc = contexts(texts)
    out: list[int | None] = [None] * len(texts)
    for c, d in zip(h.view(np.int64).tolist(), doc.tolist()):
        out[d] = c
    return [c if t and not _BREAK.match(t[-1]) and t[-1] != "…" else None for c, t in zip(out, texts)]


def _languages(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The language of each text as a number from 1 (see :data:`LANGUAGES`), 0 where it cannot be told."""
    n = len(lengths)
    ends = np.cumsum(lengths)
    per = np.zeros((n, len(LANGUAGES) + 1), np.int64)
    for code, low, high in SCRIPTS:
        at = np.flatnonzero(p - np.uint32(low) <= high - low)
        if len(at):
            per[:, LANGUAGES.index(code) + 1] += np.bincount(np.searchsorted(ends, at, side="right"), minlength=n)
    low = np.where((p - np.uint32(0xC0) < 31) & (p != 0xD7), p + np.uint32(32), p)
    latin = ((low - np.uint32(97) < 26) | (low >= 0xDF) & (low < 0x250) & (low != 0xF7)).astype(np.uint8)
    h, _, words = shingles.token_hashes(low, lengths, latin)
    doc = np.repeat(np.arange(n), words)
    place = np.minimum(np.searchsorted(_WORD_HASHES, h), len(_WORD_HASHES) - 1)
    known = _WORD_HASHES[place] == h
    hits = np.zeros((n, len(FUNCTION_WORDS)), np.int64)
    for i in range(len(FUNCTION_WORDS)):
        of = known & (_WORD_LANGUAGES[place] >> i & 1).astype(bool)
        hits[:, i] = np.bincount(doc[of], minlength=n)
    best = hits.argmax(1)
    clear = (hits.max(1) >= 3) & (hits.max(1) > 2 * hits[:, 0])
    kana, han = LANGUAGES.index("ja") + 1, LANGUAGES.index("zh") + 1
    japanese = per[:, kana] * 4 > per[:, han]
    per[:, kana] += np.where(japanese, per[:, han], 0)
    per[:, han] = np.where(japanese & (per[:, kana] > 0), 0, per[:, han])
    per[np.arange(n), np.where(clear, best, 0) + 1] += words
    return np.where(per.sum(1) < 3, 0, np.where(per[:, han] >= per.sum(1) - per[:, han], han, per.argmax(1)))


LANGUAGES = (*FUNCTION_WORDS, *dict.fromkeys(code for code, *_ in SCRIPTS))


def _function_words() -> tuple[np.ndarray, np.ndarray]:
    marks: dict[int, int] = {}
    for i, words in enumerate(FUNCTION_WORDS.values()):
        for w in words.split():
            p, n = shingles.points([w])
            h = int(shingles.token_hashes(p, n, np.ones(len(p), np.uint8))[0][0])
            marks[h] = marks.get(h, 0) | 1 << i
    at = sorted(marks)
    return np.array(at, np.uint64), np.array([marks[h] for h in at], np.int64)


_WORD_HASHES, _WORD_LANGUAGES = _function_words()


def _clauses(p: np.ndarray, lengths: np.ndarray, found: tuple, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The masked clauses of texts: hash and text number of each, and token hashes, clause and place in the clause of their tokens.

    ``found`` are the tokens of the texts, ``taken`` says which the question has
    as well (two in the same order at least); a run of such tokens is one mask.
    """
    h, place, sizes = found
    doc = np.repeat(np.arange(len(lengths)), sizes)
    clause = np.cumsum(_stops(p, lengths, _CLAUSE_MARKS))[place]
    new = shingles.distinct(clause) | shingles.distinct(doc)
    h = np.where(taken, _TAKEN, np.where(p[place] - np.uint32(48) < 10, _NUMBER, h))
    keep = new | ~taken | ~np.concatenate(([False], taken[:-1]))[: len(h)]
    number = (np.cumsum(new) - 1)[keep]
    h, begins = h[keep], np.flatnonzero(new[keep])
    if not len(begins):
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, h, empty, empty
    nth = np.arange(len(h)) - begins[number]
    whole = np.add.reduceat(shingles.mix(h + (nth + 1).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begins)
    return shingles.mix(whole), doc[new], h, number, nth


_SEEN = "row bigint, pair_id bigint, field string, defect string, declined boolean, opens boolean, advice int, question bigint, clauses array<bigint>, opening bigint, shingles array<bigint>, tail bigint"


def _lists(values: np.ndarray, doc: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)))), pa.int32()), pa.array(values.view(np.int64)))


def _inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng()  # names rows only; the table is written once
    for batch in batches:
        for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
            questions, n = part.column(1).to_pylist(), part.num_rows
            salt = shingles.mix(np.arange(n, dtype=np.uint64) + np.uint64(7))
            pq = shingles.points(questions)
            hq, _, nq = shingles.token_hashes(*pq)
            asked = [shingles.windows(hq, nq, w) for w in (3, 2)]
            asked = [h ^ salt[doc] for h, doc, _ in asked]
            theirs = _languages(*pq)
            texts_q = shingles.set_identity(hq, nq)
            identity = pa.array(shingles.mix(texts_q).view(np.int64))
            for column, field in ((2, "response_chosen"), (3, "response_rejected")):
                answers = part.column(column).to_pylist()
                given = shingles.points(answers)
                found = shingles.token_hashes(*given)
                h, _, na = found
                own = _languages(*given)
                three, doc, _ = shingles.windows(h, na, 3)
                count = np.bincount(doc, minlength=n)
                shared = np.bincount(doc, weights=shingles.held(three ^ salt[doc], asked[0]), minlength=n) / np.maximum(count, 1)
                two, doc, at = shingles.windows(h, na, 2)
                begin = np.cumsum(na) - na
                both = (begin[doc] + at)[shingles.held(two ^ salt[doc], asked[1])]
                taken = np.zeros(len(h), bool)
                taken[both] = taken[both + 1] = True
                clauses, of, tokens, number, nth = _clauses(*given, found, taken)
                # the first clause of OPENING_WIDTH tokens
                long = np.bincount(number, minlength=len(clauses)) >= OPENING_WIDTH
                first = np.flatnonzero(long)[shingles.distinct(of[long])]
                five, five_doc, _ = shingles.windows(tokens[chosen := np.isin(number, first)], np.bincount(of[number[chosen]], minlength=n), OPENING_WIDTH)
                opening = shingles.set_identity(five, np.bincount(five_doc, minlength=n)).view(np.int64)
                same = (shingles.set_identity(h, na) == texts_q) & (na == nq) & (na > 0)
                defects, tails, upto = [None] * n, [None] * n, {}
                declined = [(False, False, 0)] * n
                for i, a in enumerate(answers):
                    q = questions[i]
                    if a is None or _may_be_empty(a, na[i]) and is_empty(a):
                        defects[i] = "empty"
                        continue
                    if q and nq[i] and (count[i] and shared[i] >= COPY_SHARE or same[i]):
                        defects[i] = "copy"
                        continue
                    declined[i] = declines(a)
                    if own[i] and theirs[i] and own[i] != theirs[i] and not any(LANGUAGES[own[i] - 1] == code and pattern.search(q) for code, pattern in ASKS):
                        defects[i] = "language"
                        continue
                    how, rest = ending(a)
                    if how == "broken":
                        defects[i] = "truncated"
                    elif how == "open":
                        upto[i] = rest
                for i, tail in zip(upto, _unfinished(list(upto.values()))):
                    tails[i] = tail
                    if tail is None:
                        defects[i] = "truncated"
                has = [x not in ("empty", "copy") for x in defects]
                seen = np.array(has, bool)
                use, use5 = seen[of], seen[five_doc]
                some = np.bincount(five_doc, minlength=n) > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rng.integers(-(1 << 63), (1 << 63) - 1, n)), part.column(0), pa.array([field] * n), pa.array(defects, pa.string()), pa.array([d[0] for d in declined]), pa.array([d[1] for d in declined]), pa.array([d[2] for d in declined], pa.int32()),
                        identity, _lists(clauses[use], of[use], n), pa.array(opening, mask=~(seen & some)), _lists(five[use5], five_doc[use5], n), pa.array(tails, pa.int64()),
                    ],
                    names=["row", "pair_id", "field", "defect", "declined", "opens", "advice", "question", "clauses", "opening", "shingles", "tail"],
                )


def _count_contexts(wanted: tuple | None):
    """Occurrences of the wanted contexts in all answers and how many of them end a sentence."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                for column in (0, 1):
                    context, ends, _ = contexts(part.column(column).to_pylist())
                    use = neardup.passes(context, wanted)
                    yield pa.RecordBatch.from_arrays([pa.array(context[use].view(np.int64)), pa.array(ends[use])], names=["tail", "ends"])

    return count


def _recurring(exploded: DataFrame, key: str, refuses: str) -> DataFrame:
    """``key, n, refusing`` of what stands under LEAST_QUESTIONS different questions at least.

    Questions are told apart by 64 marks: as many marks are as many questions at least.
    """
    marks = F.bit_or(F.expr("shiftleft(1L, cast(question & 63 as int))"))
    counted = exploded.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(refuses).alias("refusing"), F.bit_count(marks).alias("questions"))
    return counted.where((F.col("questions") >= LEAST_QUESTIONS) & (F.col("n") >= LEAST_QUESTIONS)).select(key, "n", "refusing")


def _clause_counts(rows: DataFrame, share: float) -> DataFrame:
    """``clause, refuses`` of the recurring clauses of the ``evident`` answers: whether at least ``share`` of its answers, and LEAST_DECLINING, are evident."""
    clauses = rows.select("question", "evident", F.explode("clauses").alias("clause"))
    # written first, so that the few clauses are seen to be few and the others are not shuffled
    wanted = durable(clauses.where("evident").select("clause").distinct())
    found = _recurring(clauses.join(wanted, "clause", "left_semi"), "clause", "evident")
    return durable(found.select("clause", ((F.col("refusing") >= share * F.col("n")) & (F.col("refusing") >= LEAST_DECLINING)).alias("refuses")))


def _openings(rows: DataFrame, *, bands: int = 12, run: int = 3) -> DataFrame:
    """``opening`` of the openings whose cluster is a refusal template.

    The openings of ``evident`` answers are points; the cluster of one holds
    every opening of a similarity of OPENING_SIMILARITY to it. Openings share a
    shard of minimum hashes, and their shingles are compared exactly.
    """
    kinds = rows.where("opening is not null").groupBy("opening").agg(F.any_value("shingles").alias("shingles"), F.count(F.lit(1)).alias("n"), F.count_if("evident").alias("refusing"), F.bit_or(F.expr("shiftleft(1L, cast(question & 63 as int))")).alias("marks"))
    kinds = durable(kinds)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            h, sizes = lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy())
            keys = neardup.band_keys(shingles.minhashes(h, sizes, bands * run), bands, run)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), bands)), pa.array(keys.reshape(-1).view(np.int64))], names=["opening", "shard"])

    placed = kinds.select("opening", "shingles").mapInArrow(shards, "opening bigint, shard bigint")
    points = kinds.where("refusing > 0").select(F.col("opening").alias("point"), F.col("shingles").alias("own"))
    at = placed.join(points.select(F.col("point").alias("opening")), "opening", "left_semi").select(F.col("opening").alias("point"), "shard")
    near = placed.join(at, "shard").select("point", "opening").distinct().join(points, "point").join(kinds, "opening")
    common = F.size(F.array_intersect("own", "shingles"))
    near = near.where(common >= OPENING_SIMILARITY * (F.size(F.array_distinct("own")) + F.size(F.array_distinct("shingles")) - common))
    clusters = near.groupBy("point").agg(F.sum("n").alias("n"), F.sum("refusing").alias("refusing"), F.bit_count(F.bit_or("marks")).alias("questions"), F.collect_set("opening").alias("openings"))
    templates = clusters.where((F.col("questions") >= LEAST_QUESTIONS) & (F.col("refusing") >= DECLINED_SHARE * F.col("n")))
    return templates.select(F.explode("openings").alias("opening")).distinct()


def refusals(seen: DataFrame) -> DataFrame:
    """``row`` of the answers that decline and give no advice."""
    rows = seen.where("size(clauses) > 0").withColumn("evident", F.col("declined"))
    clauses = rows.select("row", F.explode("clauses").alias("clause"))
    marked = rows
    for share in SHARES:
        sure = _clause_counts(marked, share).where("refuses")
        linked = clauses.join(sure, "clause").groupBy("row").agg(F.count(F.lit(1)).alias("r")).join(rows.select("row", F.size("clauses").alias("size")), "row").where("2 * r >= size")
        linked = durable(linked.select("row", F.lit(True).alias("linked")))
        marked = rows.join(linked, "row", "left").withColumn("evident", F.col("declined") | F.col("linked").isNotNull())
    known = _clause_counts(marked, DECLINED_SHARE)
    templates = durable(_openings(marked)).withColumn("template", F.lit(1))
    told = durable(clauses.join(known, "clause").groupBy("row").agg(F.count_if("refuses").alias("r"), F.count_if(~F.col("refuses")).alias("o")))
    # rows without an opening have keys of their own, so they don't meet in one task
    judged = rows.withColumn("opening", F.coalesce("opening", "row")).join(templates, "opening", "left").join(told, "row", "left").where("declined or template is not null or r > 0")
    r, o, t, size = (F.coalesce(c, F.lit(0)) for c in (F.col("r"), F.col("o"), F.col("template"), F.size("clauses")))
    says = F.greatest(r, F.lit(1))  # the wording that declines is at least one clause of it
    opened = F.col("opens") & (o + F.col("advice") <= says)
    return judged.where(F.when(F.col("declined"), opened | (2 * says >= size)).otherwise(2 * F.greatest(r, t) >= size)).select("row")


def found(pairs: DataFrame) -> DataFrame:
    """``pair_id, field, defect``: one row for each answer that is no usable answer.

    Of several defects the first of empty, copy, refusal, language, truncated
    counts. A null or blank question excludes copy and language only. Rows with a
    null ``pair_id`` are looked at like others; an empty table gives no row.
    """
    rows = pairs.select("pair_id", "question", "response_chosen", "response_rejected")
    seen = durable(rows.mapInArrow(_inspect, _SEEN))
    asked = seen.where("defect is null and tail is not null")
    wanted = neardup.shared_filter(pairs.sparkSession, neardup._filter(asked, "tail"))
    contexts_ = pairs.select("response_chosen", "response_rejected").mapInArrow(_count_contexts(wanted), "tail bigint, ends boolean").groupBy("tail").agg(F.count(F.lit(1)).alias("n"), F.count_if("ends").alias("ends"))
    own = asked.groupBy("tail").agg(F.count(F.lit(1)).alias("own"))
    # a context counts as an end where it ends a sentence elsewhere, the undecided answers left out
    ends = contexts_.join(own, "tail").withColumn("share", (F.col("ends") - F.col("own")) / F.greatest(F.col("n") - F.col("own"), F.lit(1)))
    closing = ends.where(F.col("share") >= ENDS_SHARE).select("tail", F.lit(True).alias("closes"))
    refused = durable(refusals(seen).distinct()).withColumn("refused", F.lit(True))
    # answers without a tail have keys of their own, so they don't meet in one task
    out = seen.withColumn("open", F.col("tail").isNotNull()).withColumn("tail", F.coalesce("tail", "row")).join(closing, "tail", "left").join(refused, "row", "left")
    kind = (
        F.when(F.col("defect").isin("empty", "copy"), F.col("defect"))
        .when(F.col("refused"), "refusal")
        .when(F.col("defect").isNotNull(), F.col("defect"))
        .when(F.col("open") & F.col("closes").isNull(), "truncated")
    )
    return out.select("pair_id", "field", kind.alias("defect")).where("defect is not null")

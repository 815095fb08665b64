import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dialoom.llm import defects, neardup, overlap, quality, shingles, tokens
from dialoom.llm.boosting import Boosted
from dialoom.llm.vptree import close_pairs


def jaccard(a, b, width=3):
    x, y = (set(zip(*(t[i:] for i in range(width)))) for t in map(shingles.tokens, (a, b)))
    return len(x & y) / len(x | y) if x and y else 0.0


def edited(rng, text):
    w = text.split()
    for _ in range(rng.randrange(0, 4)):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], [f"new{rng.randrange(99)}"], [w[i], "x"]])
    if rng.random() < 0.4:
        k = rng.randrange(len(w))
        w = w[k:] + w[:k]
    return " ".join(w)


def corpus(seed, groups=25):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(12, 70)))
        rows += [edited(rng, base) for _ in range(rng.randrange(1, 5))]
    rows += [rows[0], rows[0].upper(), "", "one two", "你好", "的 " * 50, "a b c", "A-B-C!"]
    rng.shuffle(rows)
    return rows


PAIR = "pair_id long, question string, response_chosen string, response_rejected string, set_id string, a int"


def pairs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], PAIR)


def test_near_duplicates_against_brute_force(spark):
    rows = corpus(1)
    df = pairs(spark, [(i, t[: len(t) // 2] if t else None, t[len(t) // 2 :] if t else None, None) for i, t in enumerate(rows)])
    text = {i: (t[: len(t) // 2] + "\n" + t[len(t) // 2 :] if t else "\n") for i, t in enumerate(rows)}
    want = {(i, j) for i in text for j in text if i < j and jaccard(text[i], text[j]) >= 0.6}
    got = [tuple(r) for r in neardup.found(df).collect()]
    assert set(got) == want and len(got) == len(want)
    member = {r["pair_id"]: r for r in neardup.groups(df).collect()}
    parent = {i: i for i in text}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in want:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    assert {i: r["class_id"] for i, r in member.items()} == {i: root(i) for i in {x for p in want for x in p}}


def test_chunks_of_a_large_shard_lose_no_pair(spark, monkeypatch):
    rows = corpus(3, 12)
    df = pairs(spark, [(i, t, None, None) for i, t in enumerate(rows)]).repartition(3)
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if jaccard(rows[i], rows[j]) >= 0.6}
    monkeypatch.setattr(neardup, "CHUNK", 2)
    assert {tuple(r) for r in neardup.found(df).collect()} == want
    monkeypatch.setattr(neardup, "FILTER_BITS", 1)  # more values than a filter takes
    assert {tuple(r) for r in neardup.found(df).collect()} == want


def test_meetings_across_batches(monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 2)
    shard = np.sort(np.random.default_rng(2).integers(0, 30, 60))
    rows = list(zip(shard.tolist(), range(60)))
    repeated = sorted(rows + rows[:50:3] + rows[:5])
    for size in (1, 2, 7, 90):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*repeated[i : i + size])], names=["s", "i"]) for i in range(0, len(repeated), size)]
        got = [r for b in neardup._meetings(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
        met = [(s, i) for s, i in rows if (shard == s).sum() > 1]
        assert sorted(r[:2] for r in got) == met
        for s in {s for s, _ in met}:
            chunks = sorted(c for x, _, c in got if x == s)
            assert chunks == [k // 2 for k in range(len(chunks))]


def test_near_duplicates_of_nothing(spark):
    assert neardup.found(pairs(spark, [])).count() == 0 and neardup.groups(pairs(spark, [])).count() == 0
    assert neardup.found(pairs(spark, [(1, None, None, None), (2, None, "", None), (None, "a b c d", "e", None)])).count() == 0
    same = [(i, "same text over and over again", "yes it is", None) for i in range(6)]
    assert neardup.found(pairs(spark, same)).count() == 15
    assert {(r["class_id"], r["n_copies"], r["n_links"]) for r in neardup.groups(pairs(spark, same)).collect()} == {(0, 6, 0)}


def test_long_texts_meet(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    assert [tuple(r) for r in neardup.found(pairs(spark, [(1, long, "end", None), (2, long + " more", "end", None)])).collect()] == [(1, 2)]


@pytest.mark.parametrize("n, spread", [(0, 5), (1, 5), (900, 12), (700, 0), (900, 60)])
def test_vantage_points_find_every_close_pair(n, spread):
    rng = np.random.default_rng(n + spread)
    centres = rng.integers(0, 2**63, (7, 3), dtype=np.uint64)
    x = centres[rng.integers(0, 7, n)]
    for _ in range(spread):
        x = x ^ (np.uint64(1) << rng.integers(0, 63, x.shape, dtype=np.uint64))
    d = np.bitwise_count(x[:, None] ^ x[None]).sum(2)
    for r in (0, 20, 64):
        i, j = close_pairs(x, r)
        got = sorted(map(tuple, np.sort(np.stack((i, j), 1), axis=1).tolist()))
        assert len(got) == len(set(got)) and got == sorted(zip(*(v.tolist() for v in np.nonzero(np.triu(d <= r, 1)))))
        if n:
            side = rng.integers(1, 3, n)
            i, j = close_pairs(x, r, side)
            across = sorted(map(tuple, np.sort(np.stack((i, j), 1), axis=1).tolist()))
            assert across == [(a, b) for a, b in got if side[a] != side[b]]


CAND = "cand_id long, source_split string, source_hash string, question string, source_dataset string, hash string, e int"


def candidates(spark, rows):
    return spark.createDataFrame([(*r, "s", "clash", 1) for r in rows], CAND)


def test_overlaps_against_brute_force(spark):
    rng = random.Random(8)
    h = "0123456789abcdef0123456789ABCDEF01234567"
    rows = [(i, rng.choice([" Train", "train", "test ", "VALID", None]), rng.choice([None, "", "n/a", h, h.lower(), h[:-1]]) if i % 9 == 0 else None, t or None) for i, t in enumerate(corpus(5))]
    want = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] and b[1] and (a[1].strip().lower() == "train") != (b[1].strip().lower() == "train"):
                same = a[2] and b[2] and len(a[2]) == 40 and a[2].lower() == (b[2] or "").lower()
                if same or jaccard(a[3] or "", b[3] or "") >= 0.6:
                    want.add((a[0], b[0]))
    got = [tuple(r) for r in overlap.found(candidates(spark, rows)).collect()]
    assert set(got) == want and len(got) == len(want)
    report = overlap.report(candidates(spark, rows)).collect()
    evaluation = {r[0] for r in rows if r[1] and r[1].strip().lower() != "train"}
    assert sum(r["n_overlapping"] for r in report) == len(evaluation & {x for p in want for x in p}) and sum(r["n_rows"] for r in report) == len(evaluation)


def test_overlaps_of_edits_in_every_segment(spark):
    a, b = [f"w{i}" for i in range(13)], [f"v{i}" for i in range(25)]
    cases = [(a, ["x", *a[1:-1], "y"]), (b, [*b[:6], "x", *b[6:17], "y", *b[17:]])]
    rows = [(2 * i + j, "train" if j else "test", None, " ".join(t)) for i, case in enumerate(cases) for j, t in enumerate(case)]
    assert all(jaccard(*map(" ".join, case)) >= 0.6 for case in cases)
    assert sorted(tuple(r) for r in overlap.found(candidates(spark, rows)).collect()) == [(0, 1), (2, 3)]
    assert sum(r["n_overlapping"] for r in overlap.report(candidates(spark, rows)).collect()) == 2


def test_overlaps_of_nothing(spark):
    assert overlap.found(candidates(spark, [])).count() == 0 and overlap.report(candidates(spark, [])).count() == 0
    assert overlap.found(candidates(spark, [(1, "train", None, "a b c d e"), (2, None, None, "a b c d e"), (3, "", None, None)])).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def changed(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        i = rng.randrange(len(w) + 1)
        w[i : i + rng.randrange(2)] = rng.choice([[], [f"n{rng.randrange(9)}"]])
    return w


@pytest.mark.parametrize("edits", [0, 1, 3, 4])
def test_segments_meet_within_the_edits(edits):
    rng = random.Random(edits)
    for _ in range(300):
        a = [f"w{rng.randrange(6)}" for _ in range(rng.randrange(1, 24))]
        b = changed(rng, a, rng.randrange(edits + 2))
        d = distance(a, b)
        x, y = (overlap._Strings([" ".join(w)]) for w in (a, b))
        assert overlap.banded_distance([x.tokens], [y.tokens], edits)[0] == min(d, edits + 1)
        if d <= edits and len(a) > edits and b:
            assert np.isin(overlap.segments(x, edits)[0], overlap.substrings(y, edits)[0]).any()


def test_edit_pairs_against_brute_force(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(50)}" for _ in range(rng.randrange(6, 30))] for _ in range(12)]
    texts = [" ".join(changed(rng, rng.choice(base), rng.randrange(6))) for _ in range(60)] + ["", None, "a b", "a b", "A, b!", "a c"]
    rows = [(i, "test" if i % 2 else "train", None, t) for i, t in enumerate(texts)]
    got = {(r["id_e"], r["id_t"]): (r["distance"], r["copies_e"], r["copies_t"]) for r in overlap.edits_found(candidates(spark, rows), edits=3).collect()}
    side = lambda k: {w: [i for i, t in enumerate(texts) if i % 2 == k and tuple(shingles.tokens(t)) == w] for w in {tuple(shingles.tokens(t)) for i, t in enumerate(texts) if i % 2 == k} if w}
    want = {}
    for a, e in side(1).items():
        for b, t in side(0).items():
            d = distance(a, b)
            if d == 0 or d <= 3 < len(a):
                want[e[0], t[0]] = (d, len(e), len(t))
    assert got == want
    assert overlap.edits_found(candidates(spark, [])).count() == 0


def test_overlaps_near_the_threshold(spark):
    rng = random.Random(11)
    texts = []
    for g in range(60):
        w = [f"g{g}t{i}" for i in range(rng.randrange(12, 130))]
        v = list(w)
        for _ in range(rng.randrange(len(w) // 9 + 2)):
            i = rng.randrange(len(v))
            v[i : i + 1] = rng.choice([[], ["x"], [v[i], "y"]])
        if rng.random() < 0.3:
            cuts = sorted(rng.sample(range(1, len(v)), 3))
            v = v[cuts[1] : cuts[2]] + v[: cuts[0]] + v[cuts[0] : cuts[1]] + v[cuts[2] :]
        texts += [" ".join(w), " ".join(v)]
    w = [f"q{i}" for i in range(122)]
    v = [x for i, t in enumerate(w) for x in ([t, f"new{i}"] if i % 10 == 5 else [t])]
    texts += [" ".join(w), " ".join(v)]
    assert 0.6 <= jaccard(*texts[-2:]) < 0.63
    rows = [(i, "test" if i % 2 else "train", None, t) for i, t in enumerate(texts)]
    want = {(i, i + 1) for i in range(0, len(texts), 2) if jaccard(texts[i], texts[i + 1]) >= 0.6}
    assert {tuple(r) for r in overlap.found(candidates(spark, rows)).collect()} == want and len(want) > 20


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    t.encode_special_tokens = True
    return t


ODD = ["", None, " ", "a" * 5000, "aaaa aaaaa", "哈哈哈哈" * 40, "<|endoftext|> x", "I'll don't 'S", "\r\n\t　 \x00", "👩‍⚕️ é é 𠮷", "12345 67.8%", "naïve señor ¿qué?", "x" + " " * 50 + "y", "abab" * 300]


def test_ids_equal_the_library(spark, library, small):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as ids", "2 as _text", "3 as n_tokens")
    got = {r["doc_id"]: r["ids"] for r in tokens.token_ids(df).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df, "doc_id").collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_ids_do_not_depend_on_blocks(library, monkeypatch):
    merges = tokens.PairMerges(tokens.load_merges(tokens.vocabulary_path()))
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 64)
    ids, counts = merges.encode(ODD)
    assert ids.tolist() == [i for t in ODD for i in library.encode(t or "", add_special_tokens=False).ids] and len(counts) == len(ODD)


ZH = "我爸今年六十岁，最近三天一直头疼，晚上睡不好，吃了药也不见好，请问要不要去医院看看？"
GOOD = "根据您说的情况，多半和睡眠不足有关。建议先把作息调整好，白天少喝咖啡。三天后还不见好，就去神经内科看看。"
EN = "My father is sixty and has had a headache for three days. He sleeps badly and the pills do not help. Should he see a doctor?"
CASES = [
    (ZH, GOOD, None), (ZH, None, "empty"), (ZH, " \n ", "empty"), (ZH, "N/A", "empty"), (ZH, "……", "empty"), (ZH, "<p></p>", "empty"), (ZH, ZH, "copy"), (ZH, ZH.replace("，", "、").replace("我爸", "您爸"), "copy"),
    (ZH, "原问题：" + ZH, "copy"), (ZH, "您问的是“" + ZH + "”。" + GOOD * 3, None), (ZH, "抱歉，我无法回答这个问题，还请谅解。", "refusal"), (EN, "I'm sorry, but I can't help with that.", "refusal"),
    (ZH, "我不能代替医生面诊，不过可以先给您一些参考。" + GOOD, None), (ZH, "It is most likely the lack of sleep. Try to rest and drink less coffee. See a doctor if it does not get better.", "language"),
    (ZH + "请用英文回答：", "It is most likely the lack of sleep. Try to rest and drink less coffee. See a doctor if it does not get better.", None), (EN, GOOD, "language"), (ZH, GOOD[:-6], "truncated"), (ZH, GOOD + "\n2、", "truncated"),
    (ZH, GOOD + "另外，", "truncated"), (ZH, GOOD + "多保重身体", None), (None, GOOD, None), (" ", "暂无", "empty"), (EN, "It is most likely the lack of sleep. Try to rest and drink less coffee. Take care", None),
]


def test_defects_of_known_cases(spark):
    rows = [(i, q, a, GOOD) for i, (q, a, _) in enumerate(CASES)] + [(1000 + i, ZH, GOOD, GOOD) for i in range(5)]
    got = {(r["pair_id"], r["field"]): r["defect"] for r in defects.found(pairs(spark, rows)).collect()}
    wrong = [(CASES[i], got.get((i, "response_chosen"))) for i in range(len(CASES)) if got.get((i, "response_chosen")) != CASES[i][2]]
    assert not wrong
    swapped = {(r["pair_id"], r["field"]): r["defect"] for r in defects.found(pairs(spark, [(i, q, r, a) for i, q, a, r in rows])).collect()}
    assert {i: d for (i, f), d in swapped.items() if f == "response_rejected"} == {i: d for (i, f), d in got.items() if f == "response_chosen"}


def refusing(rng, wording, n):
    """Answers in a wording of their own between apologies that others use as well."""
    sorry, bye = ["抱歉，", "不好意思，", "很遗憾，"], ["，还请谅解。", "。如有其他话题，我很乐意聊聊。", "。请以线下就诊为准。"]
    return [rng.choice(sorry) + wording + rng.choice(bye) for _ in range(n)]


def test_refusals_found_by_their_templates(spark):
    rng = random.Random(5)
    known = [a for w in ("我无法回答这个问题", "关于头疼的问题我不便评论", "我没有办法给出任何说法") for a in refusing(rng, w, 12)]
    learnt = refusing(rng, "这种话题我不参与讨论", 12)
    assert not any(defects.declines(a)[0] for a in learnt)
    sound = [f"建议先{rng.choice('休热冷')}敷{rng.randrange(5, 30)}分钟，{rng.choice(['每天两次', '睡前一次'])}。{rng.randrange(2, 20)}天后还不见好，就去看看。" for _ in range(40)]
    thanks = ["很遗憾，情况不太好。" + x for x in sound]
    answers = known + learnt + sound + thanks
    rows = [(i, f"第{i}个问题是怎么回事，已经{i * 7}天了？", a, GOOD) for i, a in enumerate(answers)]
    got = {r["pair_id"] for r in defects.found(pairs(spark, rows)).where("defect = 'refusal'").collect()}
    assert got == set(range(len(known) + len(learnt)))


def test_openings_are_clustered(spark):
    rng = random.Random(6)
    words = "as a careful assistant for health matters i have been told that i must not talk about this kind of thing at all".split()
    said = [" ".join(words), " ".join([*words, "today"])]
    rows = [(f"q{i}", i < 9, said[i < 3 or i == 9]) for i in range(10)]
    seen = []
    for i, (q, declined, text) in enumerate(rows):
        h, n = shingles.sets([text], 5)
        seen.append((i, rng.getrandbits(60) // 64 * 64 + i, [1], int(shingles.set_identity(h, n).view(np.int64)[0]), h.view(np.int64).tolist(), declined))
    seen.append((10, 10, [1], 77, [1, 2, 3, 4], False))
    df = spark.createDataFrame(seen, "row long, question long, clauses array<long>, opening long, shingles array<long>, declined boolean")
    got = {r["opening"] for r in defects._openings(df.withColumn("evident", F.expr("declined and row > 2"))).collect()}
    assert got == {r[3] for r in seen[:10]} and len(got) == 2


def test_long_and_tagged_answers(spark):
    long = "I cannot help with that request. " + "Questions of this sort are not something I discuss. " * 12
    advice = "I cannot answer for your doctor. " + " ".join(f"You should rest for {i} days and keep warm." for i in range(2, 14))
    end = GOOD + "。" + "很长的一句话" * 120 + "，另外还有"
    rows = [(1, EN, long, GOOD), (2, EN, advice, None), (3, ZH, "<p></p><p></p><p></p>", "。" * 900), (4, ZH, end, None)]
    got = {(r["pair_id"], r["field"]): r["defect"] for r in defects.found(pairs(spark, rows)).collect()}
    assert got[1, "response_chosen"] == "refusal" and (2, "response_chosen") not in got
    assert got[3, "response_chosen"] == got[3, "response_rejected"] == "empty" and got[4, "response_chosen"] == "truncated"


LANGUAGE = [
    ("fr", "Il faut vous reposer pendant quelques jours et boire de l'eau avec les repas, car ce mal est dans la tête et pas au dos."), ("de", "Sie sollten sich für die nächsten Tage ausruhen und viel Wasser trinken, wenn der Schmerz nicht besser wird."),
    ("ja", "この薬は食後に飲んでください。痛みが続く場合は病院へ行きましょう。"), ("ru", "Вам нужно отдохнуть несколько дней и пить больше воды."), ("ko", "며칠 동안 쉬면서 물을 많이 드세요."), ("es", "Descanse unos días y beba más agua; si el dolor no se va, lo mejor es ir al médico."),
    ("en", "Rest for a few days and drink more water; if it is not better, go and see the doctor."), ("zh", "先休息几天，多喝水，不见好就去医院看看CT和MRI。"), (None, "37.5"),
]


def test_languages():
    got = defects._languages(*shingles.points([t for _, t in LANGUAGE]))
    assert [defects.LANGUAGES[k - 1] if k else None for k in got] == [code for code, _ in LANGUAGE]
    assert len(defects._languages(*shingles.points([]))) == 0


def test_tokens_hashed_like_the_pattern():
    texts = ["", None, "İx İ KkK", "aB1中文b2 x_y", "\U0001F600a\U0001F600", "a", "don't 37.5", "é中\u4dff\u9fffz"] + [t for _, t in LANGUAGE]
    hashes, sizes = shingles.tokenized(texts)
    words = [shingles.tokens(t) for t in texts]
    assert sizes.tolist() == list(map(len, words))
    known = {}
    assert all(known.setdefault(w, h) == h for w, h in zip((w for x in words for w in x), hashes.tolist())) and len(set(known.values())) == len(known)


def test_defects_of_nothing(spark):
    assert defects.found(pairs(spark, [])).count() == 0
    assert {r["defect"] for r in defects.found(pairs(spark, [(1, None, None, None)])).collect()} == {"empty"}


def test_boosting_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 4))
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] * x[:, 2] > 0)
    m = Boosted(4, rounds=40, depth=4).fit(x[:900], y[:900])
    assert (m.scores(x[900:]).argmax(1) == y[900:]).mean() > 0.85
    m.calibrate(x[900:], y[900:])
    assert np.allclose(m.probabilities(x[:5]).sum(1), 1)


def test_kinds_of_documents(spark, small):
    texts, kinds = quality.quality_holdout.texts()
    base = [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    rows = list(enumerate(base)) + [(10_000 + i, t) for i, t in enumerate(texts)] + [(20_000, None), (20_001, ""), (20_002, " 　\n"), (20_003, "长文。" * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kind", "2 as weak", "3 as n_words", "4 as _text")
    got = {r["doc_id"]: r["kind"] for r in quality.judged(df).select("doc_id", "kind").collect()}
    right = sum(got[10_000 + i] == k for i, k in enumerate(kinds))
    assert right >= 0.8 * len(kinds)
    assert not {20_000, 20_001, 20_002} & set(got) and len(got) == len({i for i, t in rows if t and t.strip("﻿​ \t\r\n　")})
    assert quality.found(df.limit(0)).count() == 0

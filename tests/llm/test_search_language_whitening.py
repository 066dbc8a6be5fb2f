"""Ranked search, language labels and whitening against brute force, and on edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import language_crf as crf, ranked_search as rs, whitening

rng = random.Random(9)
VOCABULARY = [f"w{i}" for i in range(60)] + ["été", "中文", "the", "of"]
POPULAR = [min(int(rng.expovariate(0.12)), 63) for _ in range(6000)]


def prose(n):
    return " ".join(rng.choice([str.upper, str.lower, str.title])(VOCABULARY[rng.choice(POPULAR)]) + rng.choice(["", ",", "."]) for _ in range(n))


TEXTS = [None, "", " .\n", "THE the", *[prose(rng.randrange(1, 90)) for _ in range(120)], prose(40_000)]
TEXTS += TEXTS[5:9] + [TEXTS[20]] * 30
ITEMS = [(1, prose(6)), (2, prose(25)), (3, None), (4, "..."), (5, "unheard words"), (None, "the of w3 w3 w3"), (1, prose(4)), (7, "ÉTÉ été")]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(rows, items, top=20):
    """By definition: all scores of all documents."""
    docs = [(i, Counter(words(t))) for i, t in rows]
    sizes = [c.total() for _, c in docs]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for item, text in items:
        scores = []
        for (i, c), size in zip(docs, sizes, strict=True):
            if size:
                m = 100 - 25 + (25 * size * n) // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w in words(text) if w in c)
                if score > 0:
                    scores.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:top], 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 30 else None, t, "x", 1) for i, t in enumerate(TEXTS)]
    rows.append(rows[9])
    return spark.createDataFrame(rows, "doc_id long, text string, block string, score int").repartition(3).cache()


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id int, text string")


@pytest.mark.parametrize("chunk", [1 << 23, 100])
def test_search_by_definition(spark, docs, monkeypatch, chunk):
    monkeypatch.setattr(rs, "CHUNK", chunk)
    got = rs.search(docs, items(spark), top=5).collect()
    want = ranked([(r.doc_id, r.text) for r in docs.collect()], ITEMS, 5)
    assert Counter(map(tuple, got)) == Counter(want)


def test_search_of_many_blocks(spark, docs):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = rs.search(docs, items(spark)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert Counter(map(tuple, got)) == Counter(ranked([(r.doc_id, r.text) for r in docs.collect()], ITEMS))


def test_search_of_nothing(spark, docs):
    assert rs.search(docs.where("doc_id = -1"), items(spark)).count() == 0
    assert rs.search(docs, items(spark).where("item_id = -1")).count() == 0
    assert rs.search(docs.where("text is null or text = ''"), items(spark)).count() == 0


def block_of(texts, query):
    """A block's lists, the query and the joint maxima, as the index has them."""
    found = [Counter(words(t)) for t in texts]
    vocabulary = {w: i for i, w in enumerate(sorted(set(words(query))))}
    df = Counter(w for c in found for w in c)
    n, total = sum(map(bool, found)), sum(c.total() for c in found)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) for w in vocabulary], np.int64)
    lists = {}
    plan = rs.Plan(vocabulary, weights, (n, total), [], np.zeros((0, 4), np.int64))
    for w, t in vocabulary.items():
        at = np.array([i for i, c in enumerate(found) if w in c], np.int32)
        if len(at):
            lists[t] = at, rs.impacts(np.full(len(at), t), np.array([found[i][w] for i in at]), np.array([found[i].total() for i in at]), plan)
    own = sorted((int(weights[vocabulary[w]]), vocabulary[w], k) for w, k in Counter(words(query)).items())
    q = rs.Query(np.array([t for _, t, _ in own]), np.array([k for *_, k in own]), np.arange(len(own) - 1))
    joint = rs.joint_maxima(lists, np.array([(*x[1:], *y[1:]) for x, y in zip(own, own[1:], strict=False)]), len(texts))
    return lists, q, joint


def test_pair_bounds_skip_more_and_lose_nothing():
    texts, more, fewer = [prose(rng.randrange(3, 40)) for _ in range(600)], 0, 0
    for _ in range(25):
        lists, q, joint = block_of(texts, prose(12))
        left, score, _ = rs.best_of(lists, q, joint, len(texts), 0)
        least = int(np.sort(score)[-20])
        a, x, seen = rs.best_of(lists, q, joint, len(texts), least)
        b, y, plainly = rs.best_of(lists, q, joint, len(texts), least, paired=False)
        want = {(int(d), int(s)) for d, s in zip(left, score, strict=True) if s >= least}
        assert {(int(d), int(s)) for d, s in zip(a, x, strict=True)} == want == {(int(d), int(s)) for d, s in zip(b, y, strict=True)}
        more, fewer = more + plainly, fewer + seen
        assert seen <= plainly
    assert fewer < 0.9 * more


def test_joint_maxima_are_of_the_intersection():
    lists, q, joint = block_of(["a b", "a a b", "a", "b c", ""], "a b c c")
    for x, most in enumerate(joint.tolist()):
        a, b = (dict(zip(lists[t][0].tolist(), (lists[t][1] * k).tolist(), strict=True)) for t, k in zip(q.terms[x : x + 2].tolist(), q.times[x : x + 2].tolist(), strict=True))
        assert most == max([a[d] + b[d] for d in a.keys() & b.keys()], default=0)


# language labels

SOUNDS = {"aa": ["ba", "ra", "ka", "ta"], "ii": ["bi", "ri", "ki", "ti"], "uu": ["nü", "mü", "lü"]}


def speech(lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_forward_backward_word_by_word():
    g = np.random.default_rng(2)
    n, t = 57, 3
    emit, trans, first = g.normal(size=(n, t)), g.normal(size=(t, t)), g.normal(size=t)
    begins = np.zeros(n, bool)
    begins[[0, 1, 20, 41, 56]] = True
    got = crf.forward_backward(emit, begins, trans, first)
    steps = np.zeros((t, t))
    cuts = [*np.flatnonzero(begins), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        e = np.exp(emit[a:b])
        ahead, back = [np.exp(first) * e[0]], [np.ones(t)]
        for x in e[1:]:
            ahead.append(ahead[-1] @ np.exp(trans) * x)
        for x in e[:0:-1]:
            back.insert(0, np.exp(trans) @ (x * back[0]))
        z = ahead[-1].sum()
        assert np.allclose(got.words[a:b], np.array(ahead) * np.array(back) / z)
        for i in range(b - a - 1):
            steps += np.outer(ahead[i], e[i + 1] * back[i + 1]) * np.exp(trans) / z
    assert np.allclose(got.steps, steps)


@pytest.fixture(scope="module")
def spoken(spark):
    rows = [(i, speech(lang, rng.randrange(3, 80)), lang, "y") for i, lang in enumerate(rng.choice(list(SOUNDS)) for _ in range(240))]
    rows += [(1000, None, "aa", "y"), (1001, "", "ii", "y"), (1002, "12 - 3", None, "y"), (1003, "– 中", None, "y"), (None, speech("uu", 9), None, "y"), rows[0], (1004, speech("ii", 30_000), "ii", "y")]
    rows += [(2000, speech("aa", 40) + ". " + speech("ii", 25) + " 7 " + speech("uu", 60), None, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, low string").repartition(3).cache()


def test_languages_of_texts_and_words(spoken):
    model = crf.learn(spoken.where("doc_id % 3 <> 1"))
    assert model.langs == ["aa", "ii", "uu"] and (np.diag(model.trans) > 0).all()
    got = {r.doc_id: r for r in crf.label_words(spoken.withColumn("score", F.lit("old")), model).collect()}
    assert all(r.lang_pred == r.lang for i, r in got.items() if i is not None and i < 1000)
    assert got[1004].lang_pred == "ii" and got[1004].runs[-1].last == 29_999
    for i in (1000, 1001, 1002):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].runs == []
    assert got[1003].lang_pred != "und" and got[None].lang_pred == "uu"
    mixed = got[2000]
    assert [r.lang for r in mixed.runs] == ["aa", "ii", "uu"] and mixed.lang_pred == "uu"
    assert [(abs(r.first - w[0]) <= 2, abs(r.last - w[1]) <= 2) for r, w in zip(mixed.runs, [(0, 39), (40, 64), (65, 124)], strict=True)] == [(True, True)] * 3
    assert 0.4 < mixed.score < 0.6 and got[0].low == "y"


def test_words_by_definition():
    texts = ["ab1cd", "", "é-ñ", "x", "y" * 50, " z"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    for piece in (1 << 21, 3):
        crf.PIECE, before = piece, crf.PIECE
        w = crf.words(data, at)
        crf.PIECE = before
        got = [(int(w.row[i]), bytes(data[w.start[k] : w.start[k] + w.length[k]]).decode()) for i, k in enumerate(w.of)]
        assert got == [(0, "ab"), (0, "cd"), (2, "é"), (2, "ñ"), (3, "x"), (4, "y" * 50), (5, "z")]


def test_nothing_to_learn(spoken):
    assert crf.learn(spoken.where("doc_id = -1")) is None and crf.learn(spoken.where("lang is null")) is None
    assert {r.lang_pred for r in crf.label_words(spoken, None).collect()} == {"und"}
    assert crf.label_words(spoken.where("doc_id = -1"), None).count() == 0
    one = crf.learn(spoken.where("lang = 'aa'"))
    assert {r.lang_pred for r in crf.label_words(spoken, one).collect()} == {"aa", "und"}


# whitening


def vectors(spark, x):
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(900, None), (901, []), (902, [float("nan")] * len(x[0])), (903, [float("inf")] + x[0][1:]), (904, [None, *x[0][1:]]), (905, x[0][:-1]), (906, [1e300] + x[0][1:]), (None, x[1])]
    rows += [(i, x[2]) for i in range(1000, 1040)]
    return spark.createDataFrame([(*r, 7, "n") for r in rows], "vec_id long, embedding array<float>, index int, at string").repartition(4)


@pytest.mark.parametrize(("rows", "columns"), [(1024, 1024), (16, 4)])
def test_whitening_by_definition(spark, monkeypatch, rows, columns):
    monkeypatch.setattr(whitening, "ROWS", rows)
    monkeypatch.setattr(whitening, "COLUMNS", columns)
    monkeypatch.setattr(whitening, "TOGETHER", 2)
    g = np.random.default_rng(4)
    x = (g.normal(size=(150, 10)) @ g.normal(size=(10, 10)) + 5).astype(np.float32).tolist()
    got = whitening.whiten(vectors(spark, x), components=6).collect()
    assert sorted((r.row.vec_id is None, r.row.vec_id or 0) for r in got) == sorted([(False, i) for i in [*range(150), *range(1000, 1040)]] + [(True, 0)])
    whole = np.floor(np.array([r.row.embedding for r in got], np.float64) * 64).astype(np.int64) + 1_000_000
    distinct = np.unique(whole, axis=0)
    n, s = len(distinct), distinct.sum(0)
    centred = distinct - s / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:6], basis[:, ::-1][:, :6]
    white = (whole - s / n) @ basis / np.sqrt(values)
    mine = np.array([r.w for r in got])
    assert np.allclose(mine, white * np.sign((mine * white).sum(0)), atol=1e-8)
    assert [r.deviation for r in got] == ((n * whole - s) ** 2).sum(1).tolist() and {r.n for r in got} == {n}
    assert np.allclose(got[0].explained, values / np.linalg.eigvalsh(centred.T @ centred / n).sum()) and max(r.identity_error for r in got) < 1e-9


def test_whitening_without_variance(spark):
    some = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(some).count() == 0
    assert whitening.whiten(some.where("vec_id = 9")).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 3.0, -float(i)]) for i in range(9)], "vec_id long, embedding array<double>")
    assert [len(r.w) for r in whitening.whiten(flat).collect()] == [1] * 9


def test_deviation_that_is_too_large(spark):
    big = spark.createDataFrame([(i, [float(i) * 2.0**33, float(-i)]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(big).collect()} == {None}

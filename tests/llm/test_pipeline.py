"""The pipeline stage by stage against plain Python, on nulls, empties, repeats, ties, long texts, empty tables, clashing and absent columns."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline as cp
import public_tokenizers as P
import pytest

from wattline.llm import bpe_tree, queries, suffix_dedup, toxicity

rng = random.Random(21)
WORDS = ["".join(rng.choice("abcdeéñ中") for _ in range(rng.randrange(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


PASSAGE, ITEM = prose(60), prose(30)
BASE = [prose(rng.randrange(20, 120)) for _ in range(30)]
TEXTS = [None, "", "  ", *BASE, *BASE[:4], *[b + " zz" for b in BASE[10:14]], *[prose(20) + " " + PASSAGE + " " + prose(20) for _ in range(3)], prose(9000) + " " + ITEM + " " + prose(50), ITEM.upper(), *[prose(30) + " you are an idiot, a stupid worthless idiot" for _ in range(6)]]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows = [(100 + i, t, rng.choice(["en", None]), "s", len(t or ""), float(i), i, "k", i) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (100, TEXTS[5], "xx", "t", 1, 2.0, 3, "k", 4), (None, "a lone text without an id", "en", "s", 25, 0.0, 0, "k", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, __wl_own int, kept string, spans int").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    toxic = [(100 + i, int("idiot" in (t or "")), 1) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(toxic + toxic[:3], "doc_id long, toxic int, quality int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def read(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir)
    out = cp.drop_toxic(spark, docs, sf_dir)
    assert out.columns == docs.columns
    model = toxicity.learn(queries.labelled(spark, docs, sf_dir, "toxic"))
    scores = {r.text: r.score for r in toxicity.score(docs.select("text"), model).collect()}
    assert bag(out.collect()) == bag(r for r in docs.collect() if scores[r.text] < 0.5)
    assert not any("idiot" in (r.text or "") for r in out.collect()) and sum(r.text is None for r in out.collect()) == 1


def test_near_duplicates(spark, sf_dir):
    docs = read(spark, sf_dir)
    rows, out = docs.collect(), cp.drop_near_copies(spark, docs, sf_dir).collect()

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    own = [shingles(r.text) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if own[i] and len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]) - 1e-9:
                group = [group[j] if g == group[i] else g for g in group]
    want = Counter()
    for g in set(group):
        members = [r for r, x in zip(rows, group, strict=True) if x == g]
        if own[group.index(g)]:
            members = sorted(members, key=lambda r: (r.doc_id is None, r.doc_id or 0))[:1]
        want.update(m.doc_id for m in members)
    assert Counter(r.doc_id for r in out) == want
    assert bag(out) - bag(rows) == Counter()


def test_repeated_passages(spark, sf_dir):
    docs = read(spark, sf_dir)
    rows, out = docs.collect(), cp.cut_repeats(spark, docs, sf_dir)
    assert out.columns == docs.columns
    raw = [(r.text or "").encode() for r in rows]
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    want = Counter()
    for r, t in zip(rows, raw, strict=True):
        gone = [False] * len(t)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        left, at = "", 0
        for ch in r.text or "":  # a character goes if all of its bytes do
            n = len(ch.encode())
            left += "" if all(gone[at : at + n]) else ch
            at += n
        want[r.doc_id, None if r.text is None else left, len(left)] += 1
    assert Counter((r.doc_id, r.text, r.n_chars) for r in out.collect()) == want
    assert cp.cut_repeats(spark, docs.select("doc_id", "text"), sf_dir).columns == ["doc_id", "text"]


def test_decontamination(spark, sf_dir):
    docs = read(spark, sf_dir)
    out = cp.drop_leaks(spark, docs, sf_dir)
    items = {tuple(w[i : i + 5]) for w in [ITEM.lower().split()] for i in range(len(w) - 4)}
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    held = lambda w: len(items & {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) >= 0.8 * len(items)
    assert bag(out.collect()) == bag(r for r in docs.collect() if not held(words(r.text)))
    assert out.count() == docs.count() - 2


def test_byte_bpe(spark, sf_dir):
    import tiktoken

    docs = read(spark, sf_dir)
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_tree.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter()
    for r in docs.collect():
        ids = known.encode_ordinary(r.text or "")
        want[r.doc_id, r.lang, r.source, r.n_chars, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    out = cp.encode(spark, docs, sf_dir)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256"] and bag(out.collect()) == want
    assert cp.encode(spark, docs.select("doc_id", "text"), sf_dir).columns[:2] == ["doc_id", "n_tokens"]


def test_empty_tables(spark, sf_dir):
    none = read(spark, sf_dir).where("doc_id = -1")
    for _, stage in cp.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_run_chains_the_stages(spark, sf_dir):
    now = read(spark, sf_dir)
    for _, stage in cp.STAGES:
        now = spark.createDataFrame(stage(spark, now, sf_dir).collect(), stage(spark, now, sf_dir).schema)
    assert bag(now.collect()) == bag(cp.run(spark, sf_dir).collect())
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "byte_bpe"]


def test_merged_spans():
    assert suffix_dedup.merged([5 << 32 | 9, 1 << 32 | 4, 4 << 32 | 6]) == [(1, 9)]

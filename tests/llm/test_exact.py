"""Operators against brute force on small texts, and on edge cases: nulls, empties, repeats, long texts, clashing columns, empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from wattline.llm import bpe_tree, decontaminate, histogram_shards, jaccard_join, license_scan, licenses, nbsvm, perplexity, suffix_dedup, toxicity, word_pieces
from wattline.llm.common import components

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdeéñ中") for _ in range(rng.randrange(1, 7))) for _ in range(300)]


def prose(n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", "  ", "\n", ". "]) for _ in range(n))


PASSAGE, LONG = prose(70), prose(20_000)
BASE = [prose(rng.randrange(5, 160)) for _ in range(40)]
TEXTS = [None, "", " \n\t", "one", "one two three", "x" * 900, LONG, LONG, *BASE, *BASE[:6], *[b + PASSAGE for b in BASE[:5]], *[b.replace(b.split()[0], "zz", 1) for b in BASE[20:30]], "Released under the MIT License", licenses.TEMPLATES["MIT-text"] + PASSAGE, PASSAGE + licenses.TEMPLATES["BSD-2-Clause-text"].replace("SOFTWARE", "CODE"), "a a a a a a a a a a a a a a", None, ""]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 12 else None, t, rng.choice(["en", "fr", None]), float(i), i, i, "x") for i, t in enumerate(TEXTS)]
    rows.append(rows[9])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, shard int, kept int, licenses string").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -5")


def texts(docs):
    return [r.text for r in docs.select("text").collect()]


def shingles(words, n=5):
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


@pytest.mark.parametrize("hot", [50_000, 3])
def test_suffix_dedup(docs, hot):
    for length in (200, 70) if hot > 3 else (70,):
        out = suffix_dedup.remove_repeats(docs.select("doc_id", "text", "kept"), length=length, hot=hot).collect()
        want = Counter(suffix_dedup.brute_force([r.text for r in out], length))
        got = Counter((len((r.text or "").encode()), sum(s.end - s.start for s in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in out)
        assert got == want


def test_characters_stay_whole(docs):
    for r in suffix_dedup.remove_repeats(docs.select("text"), length=70, characters=True).collect():
        bytes(r.kept).decode()


def test_deep_shallow_sorts():
    strings = sorted({bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(0, 90))) for _ in range(200)} | {b"a" * k for k in range(0, 130, 7)}, key=hash)
    order, common = suffix_dedup.deep_shallow(np.zeros(len(strings), np.int64), strings)
    assert [strings[i] for i in order] == sorted(strings)
    for a, b, n in zip(order, order[1:], common[1:], strict=False):
        x, y = strings[a], strings[b]
        assert x[:n] == y[:n] and (min(len(x), len(y)) == n or x[n] != y[n])
    assert [strings[i] for i in suffix_dedup.blind_trie(strings)] == sorted(strings)


@pytest.mark.parametrize("block", [512, 3])
def test_jaccard_join(docs, block):
    rows = docs.select("doc_id", "text").where("doc_id is not null").collect()
    own = [shingles(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if both and both >= 0.8 * len(own[i] | own[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r.doc_id)
    want = Counter((r.doc_id, min(least[root(i)]), links[i]) for i, r in enumerate(rows))
    got = jaccard_join.classes(docs.where("doc_id is not null"), block=block).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want
    kept = jaccard_join.keep_one(docs.where("doc_id is not null")).collect()
    blank = [r.doc_id for i, r in enumerate(rows) if not own[i]]
    assert Counter(r.doc_id for r in kept) == Counter([*{min(v) for k, v in least.items() if own[k]}, *blank])


def test_large_families_are_parted(spark):
    """Chains of texts that share half of their words meet in bands by chance; links are those of all pairs."""
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(words[i * 5 : i * 5 + 60]) for i in range(120)] + [" ".join(words[3000 + i : 3060 + i]) for i in range(60)]
    own = [shingles(t.split()) for t in texts]
    links = [sum(len(a & b) >= 0.8 * len(a | b) - 1e-9 for b in own) - 1 for a in own]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for block in (512, 10):
        got = {r.doc_id: r.n_links for r in jaccard_join.classes(frame, block=block).collect()}
        assert [got[i] for i in range(len(texts))] == links


def test_null_ids_stay(docs):
    assert jaccard_join.classes(docs).count() == docs.count()
    assert {r.doc_id for r in jaccard_join.keep_one(docs).collect()} - {r.doc_id for r in docs.collect()} == set()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101)]
    got = components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()
    assert {r.node: r.root for r in got} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_bpe_is_tiktoken(docs, monkeypatch):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe_tree.load_ranks(path)
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe_tree.decode_ids(bpe_tree.encode_texts(docs.select("text"), path, P.PATTERN), path, P.PATTERN).collect():
        assert r.ids == known.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    monkeypatch.setattr(bpe_tree, "LEAF", 5)
    monkeypatch.setattr(bpe_tree, "PIECE", 3)
    coder = bpe_tree.Coder(ranks, P.PATTERN)
    parts = ["'", "s", "'ll", "'re", "v", "e", "l", "r", " ", "  ", "\n", "a", "the", " ing", "é", "1", "22", "!", "!!", "　", "中", "'t", "x" * 40]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 40)))
        assert coder.encode(t) == known.encode_ordinary(t)


def test_histogram_shards(docs, none):
    raw = F.coalesce(F.col("text"), F.lit(""))
    for n in (4, 200):
        got = histogram_shards.shard(docs.drop("lang"), [F.xxhash64(raw), F.xxhash64("doc_id")], F.octet_length(raw) + 16, n).toPandas()
        assert len(got) == docs.count() and got.shard.between(0, n - 1).all()
        for _, g in got.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
    assert histogram_shards.shard(none, [F.xxhash64(raw), F.xxhash64("doc_id")], F.octet_length(raw) + 16, 4).count() == 0


def test_equal_bytes_and_hot_key(spark):
    frame = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.xxhash64("id")).alias("h"))
    got = histogram_shards.shard(frame, [F.col("h"), F.xxhash64("id")], F.lit(10), 16).groupBy("shard").count().toPandas()
    assert len(got) == 16 and got["count"].max() - got["count"].min() <= 2


def test_small_groups_stay_whole(spark):
    sizes = [1, 2, 3, 7, 40, 200] * 30
    rows = [(t, i, 1 + t % 3) for t, n in enumerate(sizes) for i in range(n)]
    frame = spark.createDataFrame(rows, "t long, i long, size long").select("*", F.xxhash64("t").alias("h"), F.xxhash64("t", "i").alias("b")).repartition(3)
    total = sum(r[2] for r in rows)
    for shards, sub in ((8, 10**6), (8, 100), (3, 500)):
        got = histogram_shards.shard(frame, [F.col("h"), F.col("b")], F.col("size"), shards, sub_rows=sub).toPandas()
        share = histogram_shards.GROUP_SHARE * total / shards
        per = got.groupby("t").agg(shards=("shard", "nunique"), bytes=("size", "sum"))
        assert (per.shards[per.bytes <= share] == 1).all()
        assert (got.groupby("shard")["size"].sum() - total / shards).abs().max() <= share + 3
        for _, g in got.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
        by = got.sort_values(["shard", "slot"])
        assert list(zip(by.h, by.b, strict=True)) == sorted(zip(got.h, got.b, strict=True))


def test_three_hot_texts(spark):
    frame = spark.createDataFrame([(t, i) for t in range(3) for i in range(2000)], "t long, i long")
    got = histogram_shards.shard(frame, [F.xxhash64("t"), F.xxhash64("t", "i")], F.lit(10), 4, tolerance=0.0).toPandas()
    assert sorted(got.groupby("shard").size()) == [1500] * 4


def test_slots_of_neighbouring_ties():
    for first in (list(range(6)), [3, 3, 3, 9, 9, 9], [-5] * 32 + [8] * 32, [1, 1, 2, 2, 3, 3], [-7] * 7 + [0] * 9 + [4] * 32):
        probes = np.array([(a, 10 * i) for i, a in enumerate(first)], histogram_shards.KEY)
        keys = [(a, b) for a in {*first, *(x + 1 for x in first), min(first) - 1} for b in range(-5, 10 * len(first) + 15, 5)]
        got = histogram_shards._slots(np.array([a for a, _ in keys]), np.array([b for _, b in keys]), probes)
        assert got.tolist() == [sum(tuple(p) <= k for p in probes.tolist()) for k in keys]


def test_neighbouring_hot_texts(spark):
    for low, high in ((7, 8), (-3, 40), (0, 1 << 40), (5, 6)):
        frame = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, low).otherwise(high).alias("h"))
        got = histogram_shards.shard(frame, [F.col("h"), F.xxhash64("id")], F.lit(10), 16).withColumn("b", F.xxhash64("id")).toPandas()
        assert sorted(got.groupby("shard").size()) == [250] * 16
        by = got.sort_values(["shard", "slot"])
        assert list(zip(by.h, by.b, strict=True)) == sorted(zip(by.h, by.b, strict=True))


def test_containment(docs, spark):
    items = [(1, PASSAGE), (2, " ".join(BASE[3].split()[:30])), (3, "one two"), (4, None), (5, ""), (6, prose(40)), (6, PASSAGE), (7, "ONE, two three"), (8, "one")]
    items += [(100 + n, " ".join(BASE[n % 40].split()[2 : 2 + n])) for n in range(5, 30)] + [(200 + n, " ".join(LONG.split()[5000 : 5000 + n])) for n in (5, 6, 8, 40)]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def toks(t):
        return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]

    want = set()
    for t in texts(docs):
        for i, q in items:
            s = shingles(toks(q))
            if s and len(s & shingles(toks(t))) >= 0.8 * len(s) - 1e-9:
                want.add((t, i))
    found = decontaminate.contaminated(docs.select("text"), bench)
    keyed = docs.select("text", *[c.alias(n) for c, n in zip(decontaminate.text_key(F.col("text")), ("k1", "k2"), strict=True)]).distinct()
    assert {(r.text, r.item_id) for r in keyed.join(found, ["k1", "k2"]).collect()} == want
    left = decontaminate.without_items(docs, bench)
    assert left.columns == docs.columns
    assert Counter(texts(left)) == Counter(t for t in texts(docs) if t not in {x for x, _ in want})
    assert decontaminate.without_items(docs, bench.where("item_id = 4")).count() == docs.count()


def test_word_pieces(docs):
    path = P.path("word_bpe_49k.json")
    pieces = {*word_pieces.load_pieces(path), (word_pieces.END,)}
    most = max(map(len, pieces))

    def greedy(word):
        s, i, n = (*word.encode(), word_pieces.END), 0, 0
        while i < len(s):
            j = next((j for j in range(min(len(s), i + most), i, -1) if s[i:j] in pieces), None)
            if j is None:
                return None
            n += s[i:j] != (word_pieces.END,)
            i = j
        return n

    out = word_pieces.count_pieces(docs.select("doc_id", "text"), path).toPandas()
    total = [greedy(w) or 1 for t in texts(docs) for w in word_pieces.regex.findall(word_pieces.WORD, word_pieces.normalize("NFC", t or "").lower())]
    assert out.n_tokens.sum() == sum(total) and out.n_words.sum() == len(total)
    small = word_pieces.Automaton([(1,), (1, 2, 3), (2,), (2, 4)])
    assert [small.count(w) for w in [(1, 2, 3), (1, 2, 4), (1, 2), (3,), (1, 3)]] == [1, 2, 2, -1, -1]


def test_licenses(docs):
    got = {(r.doc_id, x.template) for r in license_scan.scan(docs).collect() for x in r.licenses}
    want = set()
    for r in docs.collect():
        for name, t in license_scan.TEMPLATES.items():
            w = license_scan.tokens(t)
            n = min(5, len(w))
            if (own := license_scan.tokens(r.text)) and len(shingles(w, n) & shingles(own, n)) >= 0.8 * len(shingles(w, n)) - 1e-9:
                want.add((r.doc_id, name))
    assert got == want and want


def test_base_counts(docs):
    assert perplexity.base_counts(None) == (0, 0, 0, 0, 0)
    assert perplexity.base_counts("a b c d e a b c d e\n#x\n#x") == (12, 14, 2, 1, 10)
    assert perplexity.base_counts("a " * 7) == (7, 7, 0, 0, 7)


def test_quality_rules(docs, none):
    out = perplexity.quality_rules(docs.select("doc_id", "text", "lang", "kept")).toPandas()
    assert len(out) == docs.count() and out.kept.isin([True, False]).all() and not out.kept[out.base_failed].any()
    assert perplexity.quality_rules(none.select("doc_id", "text", "lang")).count() == 0


def test_copies_do_not_set_the_band(spark):
    own, others = prose(60), [prose(60) for _ in range(40)]
    rows = [(t, "half") for t in [own] * 60 + others] + [(t, "fewer") for t in [own] * 33 + others]
    rows += [(t, "near") for t in [*(own + f" {i}" for i in range(60)), *others]]
    rows += [(t, "two") for t in [own] * 5 + others[:1]] + [(own, "one")] * 3
    out = perplexity.quality_rules(spark.createDataFrame(rows, "text string, lang string")).toPandas()
    once = perplexity.quality_rules(spark.createDataFrame([(t, "half") for t in [own, *others]], "text string, lang string")).toPandas()
    assert not out.base_failed.any() and (out.band_low < out.band_high).all()
    share = out.groupby("lang").kept.mean()
    assert share["two"] == share["one"] == 1
    for lang in ("half", "fewer"):  # of the distinct texts as many stay as without copies, but for one
        rest = out[(out.lang == lang) & (out.perplexity > out[out.lang == lang].perplexity.min() + 1e-9)]
        assert len(rest) == 40 and rest.kept.sum() >= once.kept.sum() - 2


def test_probabilities_sum_to_one(spark):
    data = np.frombuffer(("abcabd" * 9 + LONG[:3000]).encode(), np.uint8)
    gram = next(perplexity.grams(data, np.array([0, len(data)])))[2]
    g, n = np.unique(gram, return_counts=True)
    counts = spark.createDataFrame(pd.DataFrame({"lang": "x", "gram": g, "n": n.astype("int64")}))
    model = perplexity.kneser_ney(counts).toPandas()
    assert np.exp(model.logp).groupby(model.gram // 256).sum().max() <= 1 + 1e-9


def test_grammar():
    s = toxicity.Scorer({})
    plain, aimed, negated, said = (s.weigh(t) for t in ("an idiot", "you idiot", "not an idiot", "he said idiot"))
    assert negated < said < plain < aimed and s.weigh("a calm day") == 0.0
    assert s.weigh("I will kill you") > 0 and s.weigh("they kill time") < s.weigh("I will kill you")


def test_models_learn_and_score(docs, none):
    data = [(i, "good words here " * 3 + prose(30) + (" vequmo vejuai idiot" if i % 4 == 0 else "") + (" %%% *** ###" * 9 if i % 5 == 0 else ""), int(i % 4 == 0), int(i % 5 != 0)) for i in range(400)]
    frame = docs.sparkSession.createDataFrame(data, "doc_id long, text string, toxic int, quality int")
    for module, label, least in ((toxicity, "toxic", 0.5), (nbsvm, "quality", 0.3)):
        train = frame.where("doc_id % 7 <> 0").withColumn("label", F.col(label))
        model = module.learn(train)
        held = module.score(frame.where("doc_id % 7 = 0"), model).toPandas()
        assert ((held.score >= least).astype(int) == held[label]).mean() > 0.95
        everything = module.score(docs, model).toPandas()
        assert len(everything) == docs.count() and everything.score.between(0, 1).all()
        assert module.score(none, model).count() == 0
        assert module.score(docs, module.learn(train.limit(0))).count() == docs.count()


def test_empty_tables(none):
    ids = none.select("doc_id", "text")
    assert suffix_dedup.remove_repeats(ids).count() == 0
    assert jaccard_join.classes(ids).count() == 0 and jaccard_join.keep_one(none).count() == 0
    assert license_scan.scan(none).count() == 0
    assert word_pieces.count_pieces(ids, P.path("word_bpe_49k.json")).count() == 0
    assert bpe_tree.round_trip(ids, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert decontaminate.without_items(none, ids.withColumn("item_id", F.col("doc_id"))).count() == 0

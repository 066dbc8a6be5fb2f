"""Operators against plain Python: Kneser-Ney, word pieces, transducers, the support vector solver; and every registered query."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from wattline.llm import nbsvm, perplexity, queries, toxicity, word_pieces

rng = random.Random(11)
DATA = "/root/testdata/sf0.001"
SEEDS = ["the cat sat on the mat", "a dog ran in the park", "on the hill the cat ran", "éa ñu 中文 the", "of all the parks the dog sat in", ""]


def kneser_ney(texts):
    """Probability of a byte after four others, with interpolated modified Kneser-Ney, straight from the definition."""
    grams = Counter()
    for t in texts:
        b = bytes([perplexity.START] * 4) + t.encode()
        grams.update(b[i : i + 5] for i in range(len(b) - 4))
    level = {5: dict(grams)}
    for k in (4, 3, 2, 1):
        level[k] = Counter(g[1:] for g in level[k + 1])

    def discounts(counts):
        t = [sum(n == i for n in counts.values()) for i in range(6)]
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else None
        raw = [i - (i + 1) * y * t[i + 1] / t[i] if y is not None and t[i] else None for i in (1, 2, 3)]
        return [0.5 if x is None else max(0.01, min(i - 0.01, x)) for i, x in enumerate(raw, 1)]

    d = {k: discounts(level[k]) for k in level}
    under = {k: defaultdict(list) for k in level}
    for k in level:
        for g, n in level[k].items():
            under[k][g[:-1]].append(n)

    def p(g):
        k = len(g)
        own = [d[k][min(n, 3) - 1] for n in under[k][g[:-1]]]
        total = sum(under[k][g[:-1]])
        n = level[k][g]
        return (n - d[k][min(n, 3) - 1]) / total + sum(own) / total * (p(g[1:]) if k > 1 else 1 / 256)

    return p


@pytest.mark.parametrize("most", [perplexity.HEAD, 40, 0])
def test_perplexity_is_kneser_ney(spark, most):
    texts = [" ".join(rng.choice(SEEDS) for _ in range(rng.randrange(1, 9))) for _ in range(60)] + ["the cat sat on the mat " * 3] * 5
    out = perplexity.quality_rules(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string").repartition(3), most=most, lower=1.0, upper=1.0)
    p = kneser_ney(texts)
    want = []
    for t in texts:
        b = bytes([perplexity.START] * 4) + t.encode()
        letters = sum(chr(x).isalnum() if x < 128 else x >= 192 for x in t.encode())
        want.append(math.exp(-sum(math.log(p(b[i : i + 5])) for i in range(len(b) - 4)) / letters) if letters else math.nan)
    rows = out.collect()
    assert np.allclose(sorted(r.perplexity for r in rows if r.perplexity is not None), sorted(w for w in want if not math.isnan(w)), rtol=1e-5)
    assert len({(r.band_low, r.band_high) for r in rows}) == 1
    assert all(r.kept == (not r.base_failed and r.perplexity is not None and r.band_low <= r.perplexity <= r.band_high) for r in rows)
    # one spread is a narrow band: both of its sides reject
    assert any(r.perplexity and r.perplexity < r.band_low for r in rows) and any(r.perplexity and r.perplexity > r.band_high for r in rows)


def test_perplexity_of_unknown_grams(spark):
    frame = spark.createDataFrame([("the cat sat on the mat", "x", 1, 1), ("zzzz qqqq", "x", 2, 2)], "text string, lang string, __wl_k1 long, __wl_k2 long")
    counts = frame.where("__wl_k1 = 1").select("text", "lang").mapInArrow(perplexity._count, "lang string, gram long, n long")
    model = perplexity.kneser_ney(counts)
    low = model.agg(F.min("logp")).first()[0]
    got = {r.n_words: r["__wl_sum"] for r in perplexity.scored(frame, model, "text", "lang").collect()}
    assert got[2] == pytest.approx(9 * low, rel=1e-5) and got[6] > 22 * low


def test_word_pieces_of_each_text(spark):
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

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 9000)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in word_pieces.count_pieces(docs, path).collect():
        found = [greedy(w) for w in word_pieces.regex.findall(word_pieces.WORD, word_pieces.normalize("NFC", texts[r.doc_id] or "").lower())]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(found), sum(1 if n is None else n for n in found), found.count(None))


def machines():
    """The five transducers as plain functions from (state, symbol) to (state, factor, constant)."""
    t = toxicity

    def several(s, x):
        return (1, 1.0, 0.5 if s else 0.0) if x == t.INSULT else (0 if x == t.END else s, 1.0, 0.0)

    def aimed(s, x):
        if x == t.TARGET and s == 0:
            return 1, 1.0, 0.0
        return (1, 1.25, 0.0) if s and x == t.INSULT else (0 if x == t.END else s, 1.0, 0.0)

    def negated(s, x):
        if x == t.NEGATION:
            return 3, 1.0, 0.0
        if s and x != t.END:
            return s - 1, 0.25 if x == t.INSULT else 1.0, -2.0 if x == t.THREAT else 0.0
        return 0 if x == t.END else s, 1.0, 0.0

    def reported(s, x):
        if x == t.REPORT and s == 0:
            return 1, 1.0, 0.0
        if s and x == t.INSULT:
            return 1, 0.5, 0.0
        if s and x == t.THREAT:
            return 1, 1.0, -1.0
        return 0 if x == t.END else s, 1.0, 0.0

    def threat(s, x):
        if s == 0 and x == t.MODAL:
            return 1, 1.0, 0.0
        if s == 1 and x == t.THREAT:
            return 2, 1.0, 2.0
        if s == 2 and x == t.TARGET:
            return 0, 1.0, 3.0
        return 0 if x == t.END else s, 1.0, 0.0

    return several, aimed, negated, reported, threat


def test_transducers_walked_one_by_one():
    lexicon = {"bad": 3.0, "ugl*": 2.0, "will": 9.0}
    scorer, steps = toxicity.Scorer(lexicon), machines()
    words = ["idiot", "you", "not", "said", "will", "kill", "the", "bad", "uglyfoo", "scum", "they", "never", ".", "!", "\n", "quiet", "isn't"]
    for _ in range(2000):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))
        codes = [scorer.symbol(w) for w in toxicity.TOKEN.findall(text.lower())]
        total, clause, states = 0.0, 0.0, [0] * 5
        for kind, weight in codes:
            factor = constant = 0.0
            moved = [step(s, kind) for step, s in zip(steps, states, strict=True)]
            states, factor, constant = [m[0] for m in moved], math.prod(m[1] for m in moved), sum(m[2] for m in moved)
            clause += constant + (factor * weight if kind == toxicity.INSULT else 0.0)
            if kind == toxicity.END:
                total, clause = total + max(0.0, clause), 0.0
        want = total + max(0.0, clause) if any(k in (toxicity.INSULT, toxicity.THREAT) for k, _ in codes) else 0.0
        assert scorer.weigh(text) == pytest.approx(want)


def test_dual_descent_finds_the_optimum():
    """The primal objective at the solver's weights against a long run of subgradient descent, and the duality gap."""
    gen = np.random.default_rng(3)
    rows = [np.unique(gen.integers(0, 30, gen.integers(1, 9))) for _ in range(80)]
    y = np.where(gen.random(80) < 0.4, 1.0, -1.0)
    ratio, cost = gen.normal(size=30), np.where(y > 0, 1.3, 0.7)
    w, bias = nbsvm.dual_descent(rows, y, ratio, cost, epochs=4000)
    x = np.zeros((80, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / math.sqrt(len(r))
    x[:, 30] = 1.0  # the bias is a feature like the others

    def objective(v):
        return v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()

    best, v = math.inf, np.zeros(31)
    for t in range(1, 60_001):
        v -= (v - ((cost * y * (y * (x @ v) < 1))[:, None] * x).sum(0)) / t
        if t % 50 == 0:
            best = min(best, objective(v))
    assert objective(np.append(w, bias)) <= best + 1e-3


def test_features_by_definition():
    for text in ["", "a", "abc", "aé中abc abc abc", "the the the the the x"]:
        raw = text.encode()
        want = set()
        for i in range(len(raw) - 2):
            three = raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]
            want.add((three * 2654435761 % 2**32) >> 14)
            if i + 3 < len(raw):
                want.add((((three * 2246822519 % 2**32) ^ (raw[i + 3] * 3266489917 % 2**32)) * 668265263 % 2**32) >> 14)
        words = raw.split()
        for j, n in enumerate(nbsvm.REPEATS):
            if any(len(set(words[i : i + n])) == 1 for i in range(len(words) - n + 1)):
                want.add(nbsvm.DIM + j)
        import pyarrow as pa

        assert set(next(nbsvm.features(pa.array([text]))).tolist()) == want


COLUMNS = {
    "op1_histogram_shards": "doc_id size text_crc32 law shard slot grown_shard", "op2_perplexity": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op3_word_pieces": "doc_id n_words n_tokens n_unknown",
    "op4_toxicity": "doc_id held_out score predicted", "op5_decontaminate": "doc_id item_id n_item n_found", "op6_license_scan": "doc_id template", "op7_nbsvm": "doc_id held_out score predicted", "op8_ngram_join": "doc_id class_id n_links n_copies",
    "op9_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256", "op10_bpe_tree": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11_language_crf": "doc_id held_out lang_pred score", "op12_pair_maxscore": "item_id rank doc_id score", "op13_block_whitening": "vec_id component n deviation whitened explained identity_error",
}


@pytest.mark.parametrize("key", sorted(queries.QUERIES))
def test_query(spark, key):
    out = queries.QUERIES[key](spark, DATA)
    rows = out.toPandas()
    assert set(COLUMNS[key].split()) <= set(out.columns)
    if key == "op13_block_whitening":
        assert sorted(rows.vec_id) == sorted(16 * [r.vec_id for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect()]) and rows.identity_error.max() < 1e-4
    elif key not in ("op5_decontaminate", "op6_license_scan", "op12_pair_maxscore"):
        assert sorted(rows.doc_id) == sorted(r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())
    if key in queries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = con.sql(queries.ORACLES[key])
        order = sorted(out.columns)
        assert sorted(map(str, rows[order].itertuples(index=False, name=None))) == sorted(map(str, want.df()[order].itertuples(index=False, name=None)))
    if key == "op1_histogram_shards":
        assert rows.law.eq("bytes").all() and all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
    if "held_out" in out.columns:
        import zlib

        n, held = (3, 1) if key == "op11_language_crf" else (5, 0)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == held) for r in rows.itertuples())
    if key == "op11_language_crf":
        lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
        held_out = rows[rows.held_out]
        assert rows.score.between(0, 1).all() and (held_out.lang_pred == held_out.doc_id.map(lang)).mean() >= 0.95


def test_labels_outside_the_fold(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)] + [(3, "again"), (None, "x")], "doc_id long, text string")
    spark.createDataFrame([(i % 50, i % 2) for i in range(100)] + [(None, 1), (7, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = queries.labelled(spark, docs, str(tmp_path), "toxic").toPandas()
    import zlib

    assert sorted(rows.doc_id) == sorted([i for i in range(50) if zlib.crc32(str(i).encode()) % 5] + ([3] if zlib.crc32(b"3") % 5 else []))
    assert (rows.label == rows.doc_id % 2).all()

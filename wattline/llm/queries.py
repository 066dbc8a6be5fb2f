"""The queries opN_<name>: each applies an operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattline.llm import bpe_tree, decontaminate, histogram_shards, jaccard_join, language_crf, license_scan, nbsvm, perplexity, ranked_search, suffix_dedup, toxicity, whitening, word_pieces
from wattline.llm.common import broadcast_rows, stored, text_key

SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes. A null text is 16 bytes like an empty one; copies of a text are a
    group, which stays whole unless it is over 1 % of a shard; repeated rows have slots of their own; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    raw = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.xxhash64(raw).alias("h"))
    out = histogram_shards.shard(narrow, [F.col("h"), F.xxhash64("doc_id")], F.col("size"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and perplexity bands of all documents. Null and empty texts have no words and fail the base rules; a null
    language is one of its own; copies count once in a band; very long texts are counted whole; an empty table gives no rows.
    """
    return perplexity.quality_rules(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op3_word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece counts of all documents. Null and empty texts have none; very long texts are counted whole; repeated rows stay."""
    return word_pieces.count_pieces(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def fold() -> Column:
    """Rows whose remainder is 0 are held out: labels are never learned from them."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))


def labelled(spark: SparkSession, docs: DataFrame, sf_dir: str, kind: str) -> DataFrame:
    """doc_id, text, label of the rows that may be learned from; of several labels of an id the greatest counts. Null ids and labels teach nothing."""
    labels = table(spark, sf_dir, "labels", "doc_id", kind).where(F.col(kind).isNotNull() & (fold() != 0))
    return docs.select("doc_id", "text").join(labels.groupBy("doc_id").agg(F.max(kind).alias("label")), "doc_id")


def _verdict(scored: DataFrame, least: float) -> DataFrame:
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents. Null and empty texts get the score of a text without matches; a null doc_id is not held
    out; repeated rows get equal scores; an empty table gives no rows; without labels the fixed lists alone decide.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return _verdict(toxicity.score(docs, toxicity.learn(labelled(spark, docs, sf_dir, "toxic"))), 0.5)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item in it. Null, empty and wordless texts and items have none; repeated rows have their own;
    an empty table on either side gives no rows."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = stored(decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text")), "found")
    k1, k2 = text_key(F.col("text"))
    keyed = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"))
    joined = keyed.join(broadcast_rows(found, decontaminate.BROADCAST_ROWS), ["k1", "k2"])
    return joined.select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), "n_found")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and template in it. Null, empty and wordless texts have none; repeated rows have their own."""
    out = license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.inline("licenses"))


def op7_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents. Null and empty texts are scored by the bias alone; a null doc_id is not held out; repeated
    rows get equal scores; an empty table gives no rows; without labels of both kinds the only kind is foretold.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return _verdict(nbsvm.score(docs, nbsvm.learn(labelled(spark, docs, sf_dir, "quality"))), 0.3)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and copies of all documents. Null, empty and blank texts have no links; repeated rows are copies; an empty table
    gives no rows.
    """
    return jaccard_join.classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of all documents without repeated 200-byte strings. Null counts as empty; texts under 200 bytes stay whole; repeated
    rows lose all that is 200 bytes or more; an empty table gives no rows.
    """
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents. Null counts as empty: no tokens; repeated rows stay; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe_tree.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents. Null texts and texts without a letter are `und` with score 0; a null doc_id is neither held out nor learned
    from; repeated rows are labelled alike; very long texts are read whole; an empty table gives no rows; without a language to learn all are `und`.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    out = language_crf.label_words(docs.select("doc_id", "text"), language_crf.learn(docs.where(part != 1)))
    return out.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op12_pair_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item. Null, empty and termless texts are in no list and have none; repeated rows are ranked each;
    equal scores by ascending doc_id, null last; very long texts are read whole; an empty table on either side gives no rows.
    """
    return ranked_search.search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op13_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of all embeddings. Rows without a vector or with an unusable entry are dropped; equal vectors count once in the fit, and each
    of their rows is returned; components without variance have no rows; an empty table gives no rows.
    """
    out = whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    each = F.posexplode("w").alias("at", "whitened")
    rows = out.select(F.col("row.vec_id").alias("vec_id"), "n", "deviation", "explained", "identity_error", each)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")


QUERIES = {f.__name__: f for f in (op1_histogram_shards, op2_perplexity, op3_word_pieces, op4_toxicity, op5_decontaminate, op6_license_scan, op7_nbsvm, op8_ngram_join, op9_suffix_dedup, op10_bpe_tree, op11_language_crf, op12_pair_maxscore, op13_block_whitening)}
_SHINGLES = "unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) s"

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op5_decontaminate": rf"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '') w FROM documents),
  b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '') w FROM benchmark),
  i AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, {_SHINGLES} FROM b WHERE len(w) > 0) x), n AS (SELECT item_id, count(*) n_item FROM i GROUP BY item_id),
  ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, {_SHINGLES} FROM d WHERE len(w) > 0) y WHERE s IN (SELECT s FROM i))
  SELECT doc_id, ds2.item_id, n_item, n_found FROM (SELECT doc_id, item_id, count(*) n_found FROM ds JOIN i ON i.s = ds.s GROUP BY doc_id, item_id) ds2 JOIN n ON n.item_id = ds2.item_id WHERE n_found >= 0.8e0 * n_item - 1e-9""",
    "op8_ngram_join": rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') w FROM documents),
  s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, {_SHINGLES} FROM d WHERE len(w) > 0) x), n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
  o AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b, x.n = y.n AND x.n = k AS same FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8e0 * (x.n + y.n - k) - 1e-9),
  r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
  SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = doc_id), doc_id)) class_id, coalesce(l.n_links, 0) n_links, coalesce(l.n_copies, 0) n_copies
  FROM documents LEFT JOIN (SELECT a, count(*) n_links, count(CASE WHEN same THEN 1 END) n_copies FROM e GROUP BY a) l ON l.a = doc_id""",
    "op12_pair_maxscore": f"""WITH d AS (SELECT row_number() OVER () r, doc_id, {_TERMS} t FROM documents),
  b AS (SELECT row_number() OVER () i, item_id, {_TERMS} t FROM benchmark),
  q AS (SELECT i, w, count(*) k FROM (SELECT i, unnest(t) w FROM b) x GROUP BY i, w),
  s AS (SELECT count(*) n, CAST(sum(len(t)) AS BIGINT) l FROM d WHERE len(t) > 0),
  p AS (SELECT r, w, count(*) tf FROM (SELECT r, unnest(t) w FROM d) x WHERE w IN (SELECT w FROM q) GROUP BY r, w),
  f AS (SELECT w, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) g FROM (SELECT w, count(*) df FROM p GROUP BY w) x, s),
  e AS (SELECT p.r, p.w, f.g * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(t) * n) // l))) v FROM p JOIN f ON f.w = p.w JOIN d ON d.r = p.r, s),
  z AS (SELECT i, r, CAST(sum(k * v) AS BIGINT) score FROM q JOIN e ON e.w = q.w GROUP BY i, r),
  o AS (SELECT i, doc_id, score, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) rank FROM z JOIN d ON d.r = z.r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o JOIN b ON b.i = o.i WHERE rank <= 20""",
}

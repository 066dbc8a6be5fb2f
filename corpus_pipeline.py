"""The corpus pipeline: stages over documents, each written as Parquet and read as the next one's input.

Toxic documents go, one document of each near-duplicate class stays, passages of 200 bytes and more
that repeat are cut out, documents that hold a benchmark item go, and what remains is
encoded. Nulls, empty texts and repeated rows are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.llm import bpe_tree, decontaminate, jaccard_join, queries, suffix_dedup, toxicity
from wattline.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; the model learns from labelled documents outside the held-out fold.

    Null and empty texts have the score of a text without matches and stay; copies of a text share its fate.
    """
    model = toxicity.learn(queries.labelled(spark, docs, sf_dir, "toxic"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")  # columns of any name are safe in there
    return toxicity.score(packed, model).where("score < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the least doc_id. Null, empty and blank texts stay."""
    return jaccard_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the characters that a repeated 200-byte string covers; n_chars, where there is one, is counted anew. A null text stays null."""
    cut = suffix_dedup.remove_repeats(docs.select(F.struct(*docs.columns).alias("row"), "text"), characters=True)
    own = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept").cast("string")).alias("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.coalesce(F.length(own["text"]), F.lit(0)).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return cut.select(*[own.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts stay."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars (those that there are), n_tokens, ids_sha256, decoded_sha256 of every document left; null counts as empty."""
    own = [c for c in ("doc_id", "lang", "source", "n_chars") if c in docs.columns]
    coded = bpe_tree.round_trip(docs.select(*own, "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(*own, "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: No stage but the fourth can be said in SQL (learned weights, components, suffixes, merges).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Files as sources: seed lists, and CSV bodies of documents."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wattline.functions import text as tx

#: Fields of a seed list by kind; all other columns are left out.
STRINGS = [
    "entity_id", "entity_type", "canonical_name", "aliases", "local_name", "country", "country_2", "region", "subregion", "state_province", "river", "location_accuracy", "status", "technology", "operator", "owner", "gem_location_id", "gem_unit_id",
    "gem_wiki_url", "priority_tier", "source_seed", "source_url", "dataset_version", "registry_version", "raw_record_hash",
]
FLOATS, INTS = ["latitude", "longitude", "capacity_mw"], ["commissioning_year", "retired_year", "collection_priority"]


def read_seed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, rejects) of the CSV files at path: a header, quotes doubled inside quotes, line ends inside quotes, a byte order mark.

    Everything is read as text, then typed by field: blanks are null, numbers that do not parse are null, whole numbers may be written as floats. Rows without an id or a
    name, with a place off the globe or with more or fewer cells than the header are rejects: `line` (the row's cells) and `why`; the others are loaded.
    """
    options = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8", "mode": "PERMISSIVE"}
    names = [c.lstrip("﻿") for c in spark.read.options(**options).csv(path).columns]
    schema = ", ".join(f"`{c}` string" for c in names) + ", _corrupt string"
    raw = spark.read.options(**options, enforceSchema=True, columnNameOfCorruptRecord="_corrupt").schema(schema).csv(path)
    own = {c: tx.clean(F.col(c)) for c in STRINGS if c in names} | {c: tx.clean_float(F.col(c)) for c in FLOATS if c in names} | {c: tx.clean_int(F.col(c)) for c in INTS if c in names}
    own |= {"turbines": tx.turbines(F.col("turbines"))} if "turbines" in names else {}
    own |= {"needs_review": tx.clean_bool(F.col("needs_review"))} if "needs_review" in names else {}
    typed = raw.select(*[v.alias(k) for k, v in own.items()], F.coalesce("_corrupt", F.to_json(F.struct(*names))).alias("line"), F.col("_corrupt").isNotNull().alias("_bad"))
    off = lambda c, most: F.col(c).isNotNull() & ~F.col(c).between(-most, most) if c in names else F.lit(False)
    why = F.when(F.col("_bad"), "cells").when(F.col("entity_id").isNull(), "entity_id").when(F.col("canonical_name").isNull(), "canonical_name").when(off("latitude", 90) | off("longitude", 180), "place")
    judged = typed.withColumn("why", why)
    return judged.where("why is null").drop("line", "_bad", "why"), judged.where("why is not null").select("line", "why")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one where none is set and there is one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(at or tempfile.mkdtemp(prefix='spark-wattline-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back, for what several results are made of."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def csv_rows(docs: DataFrame, doc_id: str, body: str, schema: str) -> DataFrame:
    """doc_id, nth (from 1) and the columns of schema of each row of a CSV text after its header; blank lines and a byte order mark do not count.

    A row ends where a line does with as many quotes before it as make pairs, so commas, quotes and line ends inside quotes stay. Lines are
    rows of a frame and quotes are summed over them, so a long text needs no more memory than its longest row. Missing and empty cells are null.
    """
    text = F.regexp_replace(body, "^﻿", "")
    lines = docs.select(doc_id, F.posexplode(F.split(text, r"\r?\n")).alias("at", "line"))
    order = Window.partitionBy(doc_id).orderBy("at")
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    before = F.coalesce(F.sum(quotes).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = lines.withColumn("begins", (before % 2 == 0).cast("int"))
    rows = begun.withColumn("row", F.sum("begins").over(order)).groupBy(doc_id, "row").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("lines"))
    whole = rows.select(doc_id, "row", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("line")).where(F.trim("line") != "")
    nth = F.row_number().over(Window.partitionBy(doc_id).orderBy("row")) - 1
    cells = whole.withColumn("nth", nth).where("nth > 0").select(doc_id, "nth", F.from_csv("line", schema, {"escape": '"', "multiLine": "true"}).alias("r"))
    return cells.select(doc_id, "nth", "r.*")

"""What is kept: versions of documents, changes of records, hashes of what was approved, files of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wattline.operators.frames import assign_versions

ARCHIVED = "url string, content_hash string, fetched_at timestamp, document_id string, version long"


def archive_new(existing: DataFrame, fetched: DataFrame) -> DataFrame:
    """The documents of `fetched` that the archive lacks, with their versions.

    A document is an address with a content: what the archive has is left alone, and other content of a known address gets the versions after its
    last, in the order of first fetch. Only the addresses fetched are looked up. Fetched rows without an address or hash are not archived.
    """
    new = assign_versions(fetched.where("url is not null and content_hash is not null")).drop("version").join(existing.select("document_id"), "document_id", "left_anti")
    last = existing.groupBy("url").agg(F.max("version").alias("last"))
    place = F.row_number().over(Window.partitionBy("url").orderBy("fetched_at", "content_hash"))
    return new.withColumn("place", place).join(last, "url", "left").select("url", "content_hash", "fetched_at", "document_id", (F.coalesce("last", F.lit(0)) + F.col("place")).cast("long").alias("version"))


def archive_sink(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the new documents of a batch (url, content_hash, fetched_at) to the Parquet archive at path.

    A batch that comes again after its documents were written adds nothing.
    """
    spark.createDataFrame([], ARCHIVED).write.mode("append").parquet(path)

    def write(batch: DataFrame, _id: int) -> None:
        own = batch.sparkSession
        archive_new(own.read.schema(ARCHIVED).parquet(path), batch).write.mode("append").parquet(path)

    return write


def record_history(records: DataFrame, key: list[str], order: list[str], values: list[str], context: list[str], at: str) -> DataFrame:
    """Every change of a record: key, field, old_value, new_value, context (the new row's), valid_from, valid_to of the new value.

    The rows of a key are its states in order. The first state is a change of every field that is not null; later ones
    of the fields that differ from the state before. A value is valid from its row's `at` to the next change of the
    same field of the same key, null for the one that holds. Values are compared and returned as strings.
    """
    steps = Window.partitionBy(*key).orderBy(*order)
    value = lambda c: F.col(c).cast("string")
    cells = records.select(*key, *order, *[c for c in (*context, at) if c not in order], *[F.struct(F.lag(value(c)).over(steps).alias("old"), value(c).alias("new")).alias(f"c_{c}") for c in values])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"c_{c}.old").alias("old_value"), F.col(f"c_{c}.new").alias("new_value")) for c in values])).alias("x")
    changed = cells.select(*key, *order, *[c for c in (*context, at) if c not in order], each).select("*", "x.*").drop("x").where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    until = F.lead(at).over(Window.partitionBy(*key, "field").orderBy(*order))
    return changed.select(*key, "field", "old_value", "new_value", *context, F.col(at).alias("valid_from"), until.alias("valid_to"))


def _quoted(text: Column) -> Column:
    """A JSON string as Python's json writes it with ensure_ascii=False, but that the nine control characters whose code has a letter keep it upper-case.

    Text of printable ASCII without quotes and backslashes, which is most, stays as it is; Spark's JSON writer is asked for the rest."""
    listed = F.regexp_replace(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", "$1")
    return F.when(text.rlike(r"^[ !#-\[\]-~]*\z"), F.concat(F.lit('"'), text, F.lit('"'))).when(text.isNotNull(), listed)


def json_number(x: Column) -> Column:
    """A double in the JVM's shortest form, written as Python does: 1e16 and more, and less than 0.0001, with an exponent of two digits at least."""
    plain = x.cast("string")
    text = F.upper(plain)
    digits, power = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)", 1), r"\.?0*$", ""), F.regexp_extract(text, "E(-?[0-9]+)$", 1).try_cast("int")
    sign = F.when(x < 0, "-").otherwise("")
    bare = F.replace(digits, F.lit("."), F.lit(""))
    up = F.when(F.length(bare) > power + 1, F.concat(F.substr(bare, F.lit(1), power + 1), F.lit("."), F.substr(bare, power + 2))).otherwise(F.concat(F.rpad(bare, power + 1, F.lit("0")), F.lit(".0")))
    down = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), bare)
    two = lambda p: F.lpad(p.cast("string"), F.greatest(F.lit(2), F.length(p.cast("string"))), F.lit("0"))
    exp = F.concat(digits, F.when(power < 0, F.concat(F.lit("e-"), two(-power))).otherwise(F.concat(F.lit("e+"), two(power))))
    spelled = F.when(power >= 16, exp).when(power >= 0, up).when(power >= -4, down).otherwise(exp)
    return F.when(plain.rlike(r"^[-0-9.]+\z"), plain).when(power.isNull(), text).otherwise(F.concat(sign, spelled))


def canonical_json(fields: dict[str, Column], keep_null: bool = False, tight: bool = False) -> Column:
    """A JSON object with sorted keys, nulls left out unless kept. Fields: strings, doubles (see json_number), integers, booleans, and arrays of strings or
    of objects that are JSON already (columns whose names end in _json)."""
    colon, comma = (":", ",") if tight else (": ", ", ")
    parts = []
    for name in sorted(fields):
        pair = F.concat(F.lit(f'"{name}"{colon}'), fields[name])
        parts.append(F.coalesce(pair, F.lit(f'"{name}"{colon}null')) if keep_null else pair)
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), comma), F.lit("}"))


def json_list(items: Column, quote: bool = True, tight: bool = False) -> Column:
    own = F.transform(items, _quoted) if quote else items
    return F.concat(F.lit("["), F.array_join(own, "," if tight else ", "), F.lit("]"))


def json_cell(df: DataFrame, name: str, tight: bool = False) -> Column:
    """A column of a frame as JSON, by its type."""
    kind = df.schema[name].dataType.simpleString()
    c = F.col(name)
    return json_number(c) if kind in ("double", "float") else c.cast("string") if kind in ("int", "bigint", "smallint", "boolean") else json_list(c, tight=tight) if kind.startswith("array") else _quoted(c.cast("string"))


#: What an approval is bound to.
APPROVED_FIELDS = [
    "entity_id", "period_type", "period_label", "generation_gwh", "value_type", "measurement_scope", "metric", "normalized_unit", "value_raw", "unit_raw", "snippet", "locator", "extractor", "extraction_method", "source_id", "document_id",
]


def candidate_hash(candidates: DataFrame, links: DataFrame, evidence: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """candidate_id, candidate_hash: SHA-256 of the canonical JSON of a candidate's fields that are not null, its evidence ids and their versions, both sorted.

    links: candidate_id, evidence_id; evidence: evidence_id, document_id, content_hash. Columns that candidates lack count as null. A candidate without evidence has no list of it.
    With documents (document_id, content_hash) also `whole`, whether all evidence linked is there, of its document's stored version (null without links), and `evidence_id`, the first linked one that exists.
    """
    own = evidence.select("evidence_id", "document_id", "content_hash", F.lit(True).alias("there"))
    both = links.select("candidate_id", "evidence_id").join(own, "evidence_id", "inner" if documents is None else "left")
    whole = []
    if documents is not None:
        stored = documents.select("document_id", F.col("content_hash").alias("stored_hash"))
        both = both.join(stored, "document_id", "left")
        whole = [F.min(F.coalesce(F.col("content_hash") == F.col("stored_hash"), F.lit(False))).alias("whole")]
    item = F.when(F.col("there"), F.struct("evidence_id", "document_id", "content_hash"))
    seen = both.groupBy("candidate_id").agg(F.collect_set(item).alias("items"), *whole)
    rows = candidates.join(seen, "candidate_id", "left")
    some = F.when(F.col("items").isNotNull() & (F.size("items") > 0), F.col("items"))
    ids = F.sort_array(F.array_distinct(F.transform(some, lambda x: x["evidence_id"])))
    versions = F.sort_array(F.array_distinct(F.transform(some, lambda x: canonical_json({c: _quoted(x[c]) for c in ("content_hash", "document_id", "evidence_id")}))))
    fields = {c: json_cell(candidates, c) for c in APPROVED_FIELDS if c in candidates.columns}
    fields |= {"evidence_ids": json_list(ids), "evidence_versions": json_list(versions, quote=False)}
    return rows.select("candidate_id", F.sha2(canonical_json(fields), 256).alias("candidate_hash"), *(["whole", F.array_min(ids).alias("evidence_id")] if whole else []))


def candidate_id(candidates: DataFrame, fields: list[str]) -> Column:
    """cand_ and 24 digits of the SHA-256 of the canonical JSON, without blanks and with nulls, of a candidate's own fields and its document."""
    whole = canonical_json({c: json_cell(candidates, c, tight=True) for c in fields}, keep_null=True, tight=True)
    return F.concat(F.lit("cand_"), F.substring(F.sha2(whole, 256), 1, 24))


#: Fields of an exported ranking, and the words of the report.
RANKED = ["rank", "entity_id", "canonical_name", "country", "capacity_mw", "year", "generation_gwh", "unit", "confidence_score", "source_id"]
REPORT = ["# 全球水电站发电量 Top {N} ({Y})", "", "## 统计摘要", "", "- **总记录数**: {total_records}", "- **电站数**: {total_stations}", "- **国家数**: {total_countries}", "- **总发电量**: {total_generation_twh} TWh", "- **平均发电量**: {avg_generation_gwh} GWh", "", "## 排名", ""]
REPORT_HEAD = ["排名", "电站名称", "国家", "容量(MW)", "发电量(GWh)", "置信度"]


def ranking_document(ranking: DataFrame, statistics: DataFrame, year: int, limit: int, form: str = "json") -> DataFrame:
    """The lines (`value`) of an exported ranking, in order: CSV with a header, a report in Markdown, or one JSON document that holds ranking and statistics.

    ranking: the RANKED fields, `limit` rows at most; statistics: one row (total_records, total_stations, total_countries, total_generation_twh, avg_generation_gwh).
    """
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in RANKED]
    if form == "json":
        items = ranking.agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct(*RANKED))).alias("ranking"))
        whole = items.crossJoin(statistics.select(F.struct(*statistics.columns).alias("statistics")))  # single rows
        return whole.select(F.to_json(F.struct(F.lit(year).alias("year"), F.lit(limit).alias("limit"), "count", "ranking", "statistics"), {"ignoreNullFields": "false"}).alias("value"))
    if form == "csv":
        quoted = [F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells]
        head = ranking.sparkSession.createDataFrame([(0, ",".join(RANKED))], "at int, value string")
        lines = F.concat_ws(",", *quoted)
    else:
        two = lambda c: F.format_string("%.2f", c)
        show = {c: two(F.col(c)) if statistics.schema[c].dataType.simpleString() == "double" else F.col(c).cast("string") for c in statistics.columns}

        def filled(line: str) -> Column:
            out = F.replace(F.replace(F.lit(line), F.lit("{N}"), F.lit(str(limit))), F.lit("{Y}"), F.lit(str(year)))
            for c, value in show.items():
                out = F.replace(out, F.lit("{" + c + "}"), F.coalesce(value, F.lit("")))
            return out

        table = ["| " + " | ".join(REPORT_HEAD) + " |", "|" + " --- |" * len(REPORT_HEAD)]
        head = statistics.select(F.posexplode(F.array(*[filled(x) for x in [*REPORT, *table]])).alias("p", "value")).select((F.col("p") - len(REPORT) - 2).alias("at"), "value")
        some = F.coalesce("country", F.lit("N/A"))
        row = [F.col("rank").cast("string"), F.col("canonical_name"), some, F.when(F.coalesce("capacity_mw", F.lit(0.0)) != 0, F.format_string("%.0f", "capacity_mw")).otherwise("N/A"), two(F.col("generation_gwh")), two(F.coalesce("confidence_score", F.lit(0.0)))]
        lines = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(c, F.lit("|"), F.lit("\\|")) for c in row]), F.lit(" |"))
    return head.union(ranking.select(F.col("rank").cast("int"), lines)).orderBy("at").select("value")


def export_ranking(lines: DataFrame, path: str) -> None:
    """Write the lines of `ranking_document` as one text file in the folder `path`."""
    lines.coalesce(1).write.mode("overwrite").text(path)

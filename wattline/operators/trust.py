"""The trust contract: which records may be published, and what rests on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattline.functions import text as tx
from wattline.functions.spec import TrustSpec
from wattline.sources.files import written

CHAIN_KEYS = ("entity_id", "period_type", "period_label", "value_type", "measurement_scope", "metric", "normalized_unit", "generation_gwh")


def _criteria(spec: TrustSpec) -> dict[str, Column]:
    out = {k: F.col(k) == v for k, v in spec.equalities().items()}
    return out | {"evidence_id": F.col("evidence_id").isNotNull(), "confidence": F.col("confidence") >= spec.min_confidence}


def trusted(records: DataFrame, spec: TrustSpec = TrustSpec(), year: str | None = None, entity_id: str | None = None) -> DataFrame:
    """Rows that meet every criterion; a null fails."""
    out = records.where(reduce(Column.__and__, _criteria(spec).values()))
    for name, value in (("period_label", year), ("entity_id", entity_id)):
        out = out if value is None else out.where(F.col(name) == value)
    return out


def trust_violations(records: DataFrame, spec: TrustSpec = TrustSpec()) -> DataFrame:
    """records with `violations` (names of failed criteria, in order) and `is_trusted`."""
    failed = F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in _criteria(spec).items()])
    return records.withColumn("violations", F.array_compact(failed)).withColumn("is_trusted", F.size("violations") == 0)


def trusted_chain(records: DataFrame, candidates: DataFrame, links: DataFrame, evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Records whose candidate agrees in id and eight values and leads over evidence to the document it was read from, in that version."""
    c = candidates.select("candidate_id", *CHAIN_KEYS, "document_id")
    e = evidence.select("evidence_id", "document_id", "content_hash")
    d = documents.select("document_id", "content_hash")
    chain = records.join(c, ["candidate_id", *CHAIN_KEYS]).join(links.select("candidate_id", "evidence_id"), ["candidate_id", "evidence_id"])
    return chain.join(e, ["evidence_id", "document_id"]).join(d, ["document_id", "content_hash"])


def browse(records: DataFrame, entity_id: str | None = None, year: str | None = None, value_type: str | None = None, published_only: bool = False) -> DataFrame:
    """Records that fit the filters; published ones are the trusted set, which holds actual values alone."""
    rows = trusted(records, year=year) if published_only else records if year is None else records.where(F.col("period_label") == year)
    if entity_id is not None:
        rows = rows.where(F.col("entity_id") == entity_id)
    return rows if value_type is None else rows.where(F.col("value_type") == value_type)


def top_n(rows: DataFrame, year: str, n: int = 100) -> DataFrame:
    best = rows.where(F.col("period_label") == year).orderBy(F.desc("generation_gwh"), "entity_id", "id").limit(n)
    rank = F.row_number().over(Window.orderBy(F.desc("generation_gwh"), "entity_id", "id"))  # over the n rows that are left
    return best.withColumn("rank", rank.cast("long"))


PART_ROWS = 1_000_000  # ranked in one task


def ranked(rows: DataFrame, keys: list[str], order: list[Column], first: Column, name: str = "rank", part_rows: int = PART_ROWS) -> DataFrame:
    """rows with `name`: 1, 2, ... within keys, in the given order; no task ranks more than about `part_rows` rows of a key. rows are stored once.

    first: a number by which the order begins, ascending. Large keys are cut at its percentiles; rows are numbered within
    a part and the sizes of the parts before it are added. Equal values of `first` stay in one part.
    """
    rows = written(rows, "ranked")  # they are counted, cut and numbered
    most = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = -(-most // part_rows)
    if parts <= 1:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(first, [i / parts for i in range(1, parts)], 10 * parts).alias("__cuts"))
    placed = rows.join(cuts, keys).withColumn("__at", first).withColumn("__part", F.size(F.filter("__cuts", lambda x: x < F.col("__at")))).drop("__cuts", "__at")
    sizes = placed.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*keys, "__part", before.alias("__start"))
    own = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    return placed.withColumn("__own", own).join(starts, [*keys, "__part"]).select(*rows.columns, (F.col("__start") + F.col("__own")).cast("long").alias(name))


def rank_by(rows: DataFrame, *keys: str, k: int | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """rows with their rank by generation within keys; the first k only if asked."""
    order = [F.desc("generation_gwh"), F.asc("entity_id"), F.asc("id")]
    if k is None:
        return ranked(rows, list(keys), order, -F.col("generation_gwh"), part_rows=part_rows)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))  # Spark keeps k rows of a key before it shuffles
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__wl_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__wl_n = 1").drop("__wl_n")


def detect_gaps(stations: DataFrame, trusted_rows: DataFrame, years: list[str], min_mw: float, limit: int | None = None) -> DataFrame:
    """Large stations times years without a trusted record; `limit` takes the largest stations first."""
    large = stations.where(F.col("capacity_mw") >= min_mw)
    if limit is not None:
        large = large.orderBy(F.desc("capacity_mw"), "entity_id").limit(limit)
    wanted = large.withColumn("period_label", F.explode(F.array(*map(F.lit, years))))
    have = trusted_rows.select("entity_id", "period_label").distinct()
    return wanted.join(have, ["entity_id", "period_label"], "left_anti").withColumn("priority", F.when(F.col("capacity_mw") >= 10000, "high").otherwise("medium"))


def ground_truth(cases: DataFrame, records: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Expected values against the latest actual record: missing, matched or mismatched, with the difference in percent."""
    newest = latest(records.where("value_type = 'actual'"), ["entity_id", "period_label"], F.desc("created_at"), F.desc("id")).select("entity_id", "period_label", "generation_gwh")
    diff = F.abs(F.col("generation_gwh") - F.col("expected")) / F.col("expected")
    status = F.when(F.col("generation_gwh").isNull(), "missing").when(diff <= tolerance, "matched").otherwise("mismatched")
    return cases.join(newest, ["entity_id", "period_label"], "left").withColumns({"status": status, "diff_pct": F.round(diff * 100, 4)})


def holdout_score(found: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row of counts and rates of what was found (case_id, url) against annotations (case_id, label_status, gold_urls).

    Cases that are confirmed_hit or confirmed_no_hit are reviewed; URLs match by their canonical form. recall and precision are null
    where nothing can be divided. gate_open: all cases are reviewed. One row for each case, or it is counted as often.
    """
    plain = lambda u: F.regexp_replace(tx.canonical_url(u), "/+$", "")
    urls = found.groupBy("case_id").agg(F.collect_list(plain(F.col("url"))).alias("urls"))
    rows = annotations.join(urls, "case_id", "left").withColumns({"urls": F.coalesce("urls", F.array().cast("array<string>")), "gold": F.transform("gold_urls", plain)})
    rows = rows.withColumn("hits", F.size(F.filter("urls", lambda u: F.array_contains(F.col("gold"), u))))
    status, seen = F.col("label_status"), F.col("label_status").isin("confirmed_hit", "confirmed_no_hit")
    total = lambda c: F.coalesce(F.sum(F.when(seen, c)), F.lit(0)).cast("long")
    out = rows.agg(
        F.count("*").alias("total_cases"), F.count_if(seen).alias("reviewed"), F.count_if(status == "confirmed_hit").alias("hits"), F.count_if(status == "confirmed_no_hit").alias("no_hits"),
        F.count_if((status == "confirmed_hit") & (F.col("hits") > 0)).alias("matched_hits"), total(F.size("urls")).alias("qualified"), total(F.col("hits")).alias("matched"),
    )
    return out.withColumns({
        "false_positives": F.col("qualified") - F.col("matched"), "recall": F.try_divide("matched_hits", "hits"), "precision": F.try_divide("matched", "qualified"), "gate_open": F.col("reviewed") == F.col("total_cases"),
    })

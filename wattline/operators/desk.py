"""Work lists and what people do with them: reviews, tasks, leads, overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattline.functions import text as tx
from wattline.operators.frames import TRANSITIONS, keep_old, upsert

# ---- reviews ----------------------------------------------------------------------------------


def review_list(reviews: DataFrame, candidates: DataFrame, stations: DataFrame, documents: DataFrame, sources: DataFrame, tasks: DataFrame, status: str = "open") -> DataFrame:
    """Reviews of one status with their candidate, and what is known of its station, document, source and task; reviews without a candidate go.

    source_label: user_upload or user_url where a person named the source (by how it was got), auto_search where the candidate was found
    so, else pipeline. A status that is not open, approved or rejected counts as open. sources: one row for each source_id.
    """
    status = status if status in ("open", "approved", "rejected") else "open"
    own = candidates.select("candidate_id", "entity_id", "task_id", "document_id", "period_label", "generation_gwh", "snippet", "extraction_method")
    rows = reviews.where(F.col("status") == status).select("review_id", "candidate_id", F.col("created_at").alias("review_created_at")).join(own, "candidate_id")
    rows = rows.join(stations.select("entity_id", "canonical_name", "country"), "entity_id", "left")
    rows = rows.join(documents.select("document_id", "source_id", "content_kind"), "document_id", "left")
    rows = rows.join(sources.select("source_id", F.col("title").alias("source_title"), F.col("url").alias("source_url"), "access_method"), "source_id", "left")
    rows = rows.join(tasks.select("task_id", "task_type", "user_specified_source"), "task_id", "left")
    named = F.coalesce(F.col("user_specified_source"), F.lit("")) != ""
    label = F.when(named, F.when(F.col("access_method") == "upload", "user_upload").otherwise("user_url")).when(F.col("extraction_method") == "auto_search", "auto_search").otherwise("pipeline")
    return rows.withColumn("source_label", label)


#: Fields of the first evidence that stand above the candidate's own, where they are known.
PRIMARY = ["snippet", "page_number", "source_title", "source_url", "content_kind"]


def review_detail(reviews: DataFrame, candidates: DataFrame, links: DataFrame, evidence: DataFrame, documents: DataFrame, sources: DataFrame, stations: DataFrame) -> DataFrame:
    """Reviews with their candidate, its evidence (an array by id), what the first evidence says, and what the review's payload holds.

    The first evidence's PRIMARY fields stand instead of the candidate's where they are not null. The payload is JSON: validation_issues, the candidate's flags, evidence_metadata; what is
    not JSON says nothing. Reviews without a candidate go.
    """
    origin = documents.select("document_id", "source_id", "content_kind").join(sources.select("source_id", F.col("title").alias("source_title"), F.col("url").alias("source_url")), "source_id", "left")
    shown = [c for c in PRIMARY if c in evidence.columns]
    # what documents say is laid beside evidence last, so that it is shuffled once; the first evidence is the first of the array
    each = links.join(evidence.select("evidence_id", "document_id", *shown), "evidence_id").join(origin, "document_id", "left").select("candidate_id", F.struct("evidence_id", *PRIMARY).alias("e"))
    seen = each.groupBy("candidate_id").agg(F.sort_array(F.collect_list("e")).alias("evidences"))
    rows = reviews.select("review_id", "candidate_id", F.col("status").alias("review_status"), F.col("reason").alias("review_reason"), "payload").join(candidates.drop("review_status"), "candidate_id")
    rows = rows.join(seen, "candidate_id", "left").join(stations.select("entity_id", "canonical_name", "country", "capacity_mw"), "entity_id", "left")
    first = {c: F.coalesce(F.get("evidences", F.lit(0))[c], *([F.col(c)] if c in candidates.columns else [])).alias(c) for c in PRIMARY}
    payload = F.from_json("payload", "validation_issues array<struct<code:string,severity:string>>, candidate struct<flags:array<string>>, evidence_metadata map<string,string>")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("p", payload)
    kept = [c for c in rows.columns if c not in (*PRIMARY, "payload", "p", "evidences")]
    return rows.select(
        *kept, *first.values(), F.coalesce("evidences", F.expr(f"cast(array() as {seen.schema['evidences'].dataType.simpleString()})")).alias("evidences"),
        F.coalesce("p.validation_issues", F.expr("cast(array() as array<struct<code:string,severity:string>>)")).alias("validation_issues"), F.coalesce("p.candidate.flags", none).alias("candidate_flags"), F.col("p.evidence_metadata").alias("evidence_metadata"),
    )


def backfill_tasks(reviews: DataFrame, candidates: DataFrame, links: DataFrame, evidence: DataFrame, records: DataFrame, tasks: DataFrame) -> dict[str, DataFrame]:
    """Tasks for reviews whose task is missing, and reviews, candidates, evidence and records with their empty task_id filled; what is set is left.

    A review's task is its own, else its candidate's, else `manual_review::` and 16 digits of the hash of the candidate's id (of the review's where it has no candidate).
    New tasks are those that `tasks` lacks. Evidence of several candidates gets the least of their tasks.
    """
    own = candidates.select("candidate_id", F.col("task_id").alias("own_task"), F.col("entity_id").alias("own_entity"), F.col("period_label").alias("own_period"))
    digest = F.substring(F.sha2(F.coalesce("candidate_id", "review_id"), 256), 1, 16)
    rows = reviews.join(own, "candidate_id", "left").withColumn("digest", digest)
    rows = rows.withColumn("to_task", F.coalesce("task_id", "own_task", F.concat(F.lit("manual_review::"), "digest")))
    wanted = rows.join(tasks.select(F.col("task_id").alias("to_task")), "to_task", "left_anti")
    new = wanted.groupBy(F.col("to_task").alias("task_id")).agg(F.min_by(F.struct(F.coalesce("own_entity", "entity_id").alias("entity_id"), F.concat(F.coalesce("own_period", F.lit("-")), F.lit("::review::"), "digest").alias("target_period"), F.concat(F.lit("review://"), "review_id").alias("user_specified_source")), "review_id").alias("x"))
    made = new.select("task_id", "x.*", F.lit("station").alias("entity_type"), F.lit("user_query").alias("task_type"), F.lit("needs_review").alias("status"), F.lit("manual").alias("source_type"))
    fill = wanted.where("candidate_id is not null").groupBy("candidate_id").agg(F.min("to_task").alias("fill"))

    def filled(df: DataFrame, by: DataFrame, key: str) -> DataFrame:
        return df.join(by, key, "left").withColumn("task_id", F.coalesce("task_id", "fill")).drop("fill")

    by_evidence = links.join(fill, "candidate_id").groupBy("evidence_id").agg(F.min("fill").alias("fill"))
    by_review = wanted.select("review_id", F.col("to_task").alias("fill"))
    return {"tasks": made, "reviews": filled(reviews, by_review, "review_id"), "candidates": filled(candidates, fill, "candidate_id"), "evidence": filled(evidence, by_evidence, "evidence_id"), "records": filled(records, fill, "candidate_id")}


# ---- tasks and leads --------------------------------------------------------------------------


def task_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tasks created again: what they are about is refreshed, how they ran stays, and only a source that a person named replaces another."""
    manual = F.col("__new_source_type").eqNullSafe("manual")
    named = lambda was, now, _: F.when(manual, now).otherwise(was)
    ran = {c: keep_old for c in ("status", "attempts", "max_attempts", "failure_stage", "created_at") if c in old.columns}
    return upsert(old, new, ["task_id"], ran | {"source_type": named, "user_specified_source": named})


def cancel_many(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """tasks with those of ids (task_id) cancelled, if all of them exist and may be cancelled; else as they were. `changed` tells which were."""
    legal = [s for s, after in TRANSITIONS.items() if "cancelled" in after] + ["cancelled"]
    asked = ids.select("task_id").distinct().withColumn("asked", F.lit(True))
    refused = asked.join(tasks.select("task_id", "status"), "task_id", "left").agg(F.count_if(~F.coalesce(F.col("status").isin(*legal), F.lit(False))).alias("refused"))
    rows = tasks.join(asked, "task_id", "left").crossJoin(refused)  # one row
    go = F.coalesce("asked", F.lit(False)) & (F.col("refused") == 0) & (F.col("status") != "cancelled")
    return rows.withColumn("changed", go).withColumn("status", F.when(F.col("changed"), "cancelled").otherwise(F.col("status"))).drop("asked", "refused")


def cancel_by_prefix(tasks: DataFrame, prefix: str) -> DataFrame:
    """tasks with those cancelled that are not at their end and whose id, or entity's id, begins with prefix."""
    hit = F.col("task_id").startswith(prefix) | F.col("entity_id").startswith(prefix)
    return cancel_many(tasks, tasks.where(hit & F.col("status").isin("pending", "running", "failed", "needs_review")))


def record_leads(leads: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leads with the results of searches, the lead of each address of a task: task_id, key, lead_id).

    results: task_id, provider, query, url, rank, title, snippet; what is no web address is left out. A lead's id is that of its task, provider, query, address and rank, so the same search adds
    none. A known lead gets title, snippet and status anew, but a rejected one stays rejected. Of several leads of an address, without regard to case and a closing slash, the first by rank is the one.
    """
    found = results.where(F.trim("url").rlike("^https?://")).withColumn("url", F.trim("url"))
    found = found.withColumn("lead_id", tx.stable_id("lead_", F.col("task_id"), F.col("provider"), F.col("query"), F.col("url"), F.col("rank").cast("string")))
    rows = found.select("lead_id", "task_id", "provider", "query", "url", "rank", F.substring("title", 1, 500).alias("title"), F.substring("snippet", 1, 2000).alias("snippet"), F.lit("discovered").alias("status")).dropDuplicates(["lead_id"])
    stays = lambda was, now, _: F.when(was == "rejected", was).otherwise(now)
    merged = upsert(leads.select(*rows.columns), rows, ["lead_id"], {"status": stays} | {c: keep_old for c in ("task_id", "provider", "query", "url", "rank")})
    key = F.lower(F.regexp_replace("url", "/+$", ""))
    first = rows.groupBy("task_id", key.alias("key")).agg(F.min_by("lead_id", F.struct("rank", "lead_id")).alias("lead_id"))
    return merged, first


# ---- overviews --------------------------------------------------------------------------------


def status_overview(tasks: DataFrame, records: DataFrame, reviews: DataFrame) -> DataFrame:
    """what, n: tasks of each status, records in all and publishable, open reviews."""
    by_status = tasks.groupBy(F.concat(F.lit("task:"), "status").alias("what")).agg(F.count("*").alias("n"))
    single = lambda df, what, n: df.agg(n.alias("n")).select(F.lit(what).alias("what"), "n")
    out = by_status.union(single(records, "records", F.count("*"))).union(single(records, "publishable", F.count_if(F.col("publication_status") == "publishable")))
    return out.union(single(reviews, "open_reviews", F.count_if(F.col("status") == "open")))


def top_values(df: DataFrame, dim: str, column: str, most: int | None = None) -> DataFrame:
    """dim, v, n of the values of a column, blanks as (blank); the commonest `most`."""
    value = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("(blank)"))
    out = df.groupBy(value.alias("v")).agg(F.count("*").alias("n")).select(F.lit(dim).alias("dim"), "v", "n")
    return out if most is None else out.orderBy(F.desc("n"), "v").limit(most)


def seed_profile(rows: DataFrame, most: int = 20) -> DataFrame:
    """dim, v, n: how a list of entities is made up, and how many of its rows have what fault.

    rows: status, technology, country, priority_tier, location_id, unit_id, canonical_name, capacity_mw, latitude, longitude, needs_review. A repeat of an id that is
    not blank counts from its second row on. The commonest `most` countries are listed, all are counted.
    """
    lists = top_values(rows, "status", "status").union(top_values(rows, "technology", "technology")).union(top_values(rows, "country", "country", most)).union(top_values(rows, "tier", "priority_tier"))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    again = lambda c: F.count_if(~blank(c)) - F.count_distinct(F.when(~blank(c), F.col(c)))
    outside = lambda c, most: F.count_if(F.col(c).isNotNull() & ~F.col(c).between(-most, most))
    checks = {
        "duplicate_location_id": again("location_id"), "duplicate_unit_id": again("unit_id"), "missing_name": F.count_if(blank("canonical_name")), "missing_capacity": F.count_if(F.col("capacity_mw").isNull()),
        "capacity_nonpositive": F.count_if(F.coalesce(F.col("capacity_mw"), F.lit(0.0)) <= 0), "capacity_below_zero": F.count_if(F.col("capacity_mw") < 0), "invalid_latitude": outside("latitude", 90), "invalid_longitude": outside("longitude", 180),
        "needs_review_rows": F.count_if(F.col("needs_review")), "countries": F.count_distinct(F.when(~blank("country"), F.col("country"))), "rows": F.count("*"),
    }
    one = rows.agg(*[v.alias(k) for k, v in checks.items()])
    return lists.union(one.select(F.explode(F.array(*[F.struct(F.lit("check").alias("dim"), F.lit(k).alias("v"), F.col(k).cast("long").alias("n")) for k in checks])).alias("x")).select("x.*"))


def evaluation(cases: DataFrame) -> DataFrame:
    """kind, name, value: rates by stage and by field, accuracy of values (mean and median), the whole, errors by stage, how many failed.

    cases: source_discovered, acquisition_success, parse_success, extraction_success, entity_match, year_match, unit_match, overall_pass (booleans),
    value_accuracy, error_stage. Without cases all rates are 0.
    """
    rate = lambda c: F.coalesce(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")), F.lit(0.0))
    stages, fields = ["source_discovered", "acquisition_success", "parse_success", "extraction_success"], ["entity_match", "year_match", "unit_match"]
    parts = [("stage", c, rate(c)) for c in stages] + [("field", c, rate(c)) for c in fields] + [("record", "overall_pass", rate("overall_pass"))]
    value = F.col("value_accuracy")
    parts += [("value", "mean", F.coalesce(F.avg(value), F.lit(0.0))), ("value", "median", F.coalesce(F.median(value), F.lit(0.0))), ("cases", "total", F.count("*").cast("double")), ("cases", "failed", F.count_if(~F.coalesce(F.col("overall_pass"), F.lit(False))).cast("double"))]
    one = cases.agg(*[x.alias(f"x{i}") for i, (_, _, x) in enumerate(parts)])
    flat = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), F.col(f"x{i}").alias("value")) for i, (k, n, _) in enumerate(parts)])).alias("x")).select("x.*")
    errors = cases.where("error_stage is not null").groupBy("error_stage").agg(F.count("*").cast("double").alias("value"))
    return flat.union(errors.select(F.lit("error"), "error_stage", "value"))


def search_everywhere(needle: str, groups: dict[str, tuple[DataFrame, str, str]], most: int = 5) -> DataFrame:
    """kind, id of what has the needle in its name, without regard to case: the first `most` of each kind by id. A needle of under two characters finds nothing.

    groups: kind -> (frame, column of the name, column of the id).
    """
    out = None
    for kind, (df, name, key) in groups.items():
        hit = F.contains(F.lower(F.col(name)), F.lit(needle.lower())) if len(needle.strip()) >= 2 else F.lit(False)
        part = df.where(hit).orderBy(key).limit(most).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"))
        out = part if out is None else out.union(part)
    return out

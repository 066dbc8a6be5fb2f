"""Queries on reviews, tasks, leads and overviews."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from wattline.functions import text as tx
from wattline.operators import desk as dk, trust as t
from wattline.plans.registry import query

C = F.col


@query("review_list", "review_rows review_candidates stations archive source_list asked_tasks", """SELECT review_id, c.entity_id, round(generation_gwh, 4) gwh, canonical_name, country, content_kind, src.title source_title, src.url source_url, CASE WHEN coalesce(user_specified_source, '') <> '' THEN CASE WHEN access_method = 'upload' THEN 'user_upload' ELSE 'user_url' END WHEN extraction_method = 'auto_search' THEN 'auto_search' ELSE 'pipeline' END source_label
  FROM review_rows r JOIN review_candidates c ON c.candidate_id = r.candidate_id LEFT JOIN stations s ON s.entity_id = c.entity_id LEFT JOIN archive d ON d.document_id = c.document_id LEFT JOIN source_list src ON src.source_id = d.source_id LEFT JOIN asked_tasks t ON t.task_id = c.task_id WHERE r.status = 'open'""")
def _(*frames):
    out = dk.review_list(*frames)
    return out.select("review_id", "entity_id", F.round("generation_gwh", 4).alias("gwh"), "canonical_name", "country", "content_kind", "source_title", "source_url", "source_label")


@query("review_detail", "review_rows review_candidates candidate_evidence shown_evidence archive source_list stations", """, seen AS (SELECT candidate_id, string_agg(e.evidence_id, ',' ORDER BY e.evidence_id) ids, arg_min(row(e.snippet, e.page_number, src.title, d.content_kind), e.evidence_id) one FROM candidate_evidence ce JOIN shown_evidence e ON e.evidence_id = ce.evidence_id LEFT JOIN archive d ON d.document_id = e.document_id LEFT JOIN source_list src ON src.source_id = d.source_id GROUP BY candidate_id)
  SELECT review_id, r.status review_status, coalesce(ids, '') evidences, coalesce(one[1], c.snippet) snippet, one[2] page_number, one[3] source_title, one[4] content_kind, canonical_name, CASE WHEN review_id LIKE '%1' THEN 'A,B' ELSE '' END issues, CASE WHEN review_id LIKE '%1' THEN 'OCR_DERIVED,X' ELSE '' END flags, CASE WHEN review_id LIKE '%3' THEN '3' END noted_page
  FROM review_rows r JOIN review_candidates c ON c.candidate_id = r.candidate_id LEFT JOIN seen ON seen.candidate_id = c.candidate_id LEFT JOIN stations s ON s.entity_id = c.entity_id""")
def _(*frames):
    out = dk.review_detail(*frames)
    joined = lambda c: F.array_join(c, ",")
    return out.select("review_id", "review_status", joined(F.transform("evidences", lambda e: e["evidence_id"])).alias("evidences"), "snippet", "page_number", "source_title", "content_kind", "canonical_name", joined(F.transform("validation_issues", lambda i: i["code"])).alias("issues"), joined(C("candidate_flags")).alias("flags"), F.try_element_at("evidence_metadata", F.lit("page")).alias("noted_page"))


DIGEST = "substr(sha256(coalesce(r.candidate_id, review_id)), 1, 16)"


@query("backfill_task", "review_rows review_candidates candidate_evidence shown_evidence task_records asked_tasks", f""", wide AS (SELECT r.review_id, r.candidate_id, coalesce(r.task_id, c.task_id, 'manual_review::' || {DIGEST}) to_task, coalesce(c.entity_id, r.entity_id) entity_id, coalesce(c.period_label, '-') || '::review::' || {DIGEST} period FROM review_rows r LEFT JOIN review_candidates c ON c.candidate_id = r.candidate_id),
  wanted AS (SELECT * FROM wide WHERE to_task NOT IN (SELECT task_id FROM asked_tasks)), fill AS (SELECT candidate_id, min(to_task) f FROM wanted GROUP BY candidate_id), by_evidence AS (SELECT evidence_id, min(f) f FROM candidate_evidence ce JOIN fill ON fill.candidate_id = ce.candidate_id GROUP BY evidence_id)
  SELECT 'tasks' AS what, to_task id, arg_min(entity_id || '/' || period || '/review://' || review_id, review_id) task_id FROM wanted GROUP BY to_task UNION ALL SELECT 'reviews', r.review_id, coalesce(r.task_id, to_task) FROM review_rows r LEFT JOIN wanted w ON w.review_id = r.review_id UNION ALL SELECT 'candidates', c.candidate_id, coalesce(task_id, f) FROM review_candidates c LEFT JOIN fill ON fill.candidate_id = c.candidate_id
  UNION ALL SELECT 'evidence', e.evidence_id, coalesce(task_id, f) FROM shown_evidence e LEFT JOIN by_evidence b ON b.evidence_id = e.evidence_id UNION ALL SELECT 'records', cast(id AS string), coalesce(task_id, f) FROM task_records r LEFT JOIN fill ON fill.candidate_id = r.candidate_id""")
def _(*frames):
    out = dk.backfill_tasks(*frames)
    rows = out["tasks"].select(F.lit("tasks").alias("what"), C("task_id").alias("id"), F.concat_ws("/", "entity_id", "target_period", "user_specified_source").alias("task_id"))
    for what, key in (("reviews", "review_id"), ("candidates", "candidate_id"), ("evidence", "evidence_id"), ("records", "id")):
        rows = rows.union(out[what].select(F.lit(what), C(key).cast("string"), "task_id"))
    return rows


@query("task_upsert", "known_tasks created_tasks", """SELECT coalesce(o.task_id, n.task_id) task_id, CASE WHEN n.task_id IS NULL THEN o.entity_id ELSE n.entity_id END entity_id, CASE WHEN n.task_id IS NULL THEN o.priority_tier ELSE n.priority_tier END priority_tier, CASE WHEN o.task_id IS NULL THEN n.status ELSE o.status END status, CASE WHEN o.task_id IS NULL THEN n.attempts ELSE o.attempts END attempts,
  CASE WHEN o.task_id IS NULL OR n.source_type = 'manual' THEN n.source_type ELSE o.source_type END source_type, CASE WHEN o.task_id IS NULL OR n.source_type = 'manual' THEN n.user_specified_source ELSE o.user_specified_source END user_specified_source FROM known_tasks o FULL JOIN created_tasks n ON n.task_id = o.task_id""")
def _(old, new):
    return dk.task_upsert(old, new)


LEAD = "'lead_' || substr(sha256(task_id || chr(31) || provider || chr(31) || query || chr(31) || trim(url) || chr(31) || cast(rank AS string)), 1, 20)"


@query("lead_upsert", "lead_results", f""", l AS (SELECT *, {LEAD} lead_id FROM lead_results WHERE lower(trim(url)) LIKE 'http%'), k AS (SELECT DISTINCT lead_id, CASE WHEN page_id % 6 = 0 THEN 'rejected' ELSE 'fetched' END status FROM l WHERE page_id % 3 = 0)
  SELECT DISTINCT 'lead' AS what, l.lead_id, l.task_id || ' ' || trim(l.url) key, CASE WHEN k.status = 'rejected' THEN 'rejected' ELSE 'discovered' END status FROM l LEFT JOIN k ON k.lead_id = l.lead_id
  UNION ALL SELECT 'address', arg_min(lead_id, (rank, lead_id)), task_id || ' ' || lower(rtrim(trim(url), '/')), NULL FROM l GROUP BY task_id, lower(rtrim(trim(url), '/'))""")
def _(results):
    """A third of the leads are known, some of them rejected."""
    rank = C("rank").cast("string")
    known = results.where("page_id % 3 = 0 and page_id % 9 <> 8").select(tx.stable_id("lead_", C("task_id"), C("provider"), C("query"), F.trim("url"), rank).alias("lead_id"), "task_id", "provider", "query", F.trim("url").alias("url"), "rank", F.lit("old").alias("title"), "snippet", F.when(C("page_id") % 6 == 0, "rejected").otherwise("fetched").alias("status")).distinct()
    leads, first = dk.record_leads(known, results.drop("page_id"))
    own = leads.select(F.lit("lead").alias("what"), "lead_id", F.concat_ws(" ", "task_id", "url").alias("key"), "status")
    return own.union(first.select(F.lit("address"), "lead_id", F.concat_ws(" ", "task_id", "key"), F.lit(None).cast("string")))


@query("cancel_by_prefix", "tasks", """SELECT 'prefix' AS what, task_id, CASE WHEN hit AND status IN ('pending', 'running', 'failed', 'needs_review') THEN 'cancelled' ELSE status END status, hit AND status IN ('pending', 'running', 'failed', 'needs_review') changed FROM (SELECT *, task_id LIKE 'T12%' OR entity_id LIKE 'T12%' hit FROM tasks) x UNION ALL SELECT 'refused', task_id, status, false FROM tasks
  UNION ALL SELECT 'list', task_id, CASE WHEN task_id LIKE '%3' AND status IN ('pending', 'running') THEN 'cancelled' ELSE status END, task_id LIKE '%3' AND status IN ('pending', 'running') FROM tasks""")
def _(tasks):
    """A prefix; a list with tasks that are at their end, which changes nothing; a list of tasks that may all be cancelled."""
    kinds = {"prefix": dk.cancel_by_prefix(tasks, "T12"), "refused": dk.cancel_many(tasks, tasks.where("task_id like '%2'")), "list": dk.cancel_many(tasks, tasks.where("task_id like '%3' and status in ('pending', 'running')"))}
    parts = [df.select(F.lit(k).alias("what"), "task_id", "status", "changed") for k, df in kinds.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("status_overview", "tasks records reviews", """SELECT 'task:' || status AS what, count(*) n FROM tasks GROUP BY status UNION ALL SELECT 'records', count(*) FROM records UNION ALL SELECT 'publishable', count(*) FROM records WHERE publication_status = 'publishable' UNION ALL SELECT 'open_reviews', count(*) FROM reviews WHERE status = 'open'""")
def _(tasks, records, reviews):
    return dk.status_overview(tasks, records, reviews)


@query("seed_profile", "seed_rows", """SELECT 'status' dim, coalesce(nullif(status, ''), '(blank)') v, count(*) n FROM seed_rows GROUP BY 2 UNION ALL SELECT 'technology', coalesce(nullif(technology, ''), '(blank)'), count(*) FROM seed_rows GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'country', coalesce(nullif(country, ''), '(blank)') c, count(*) n FROM seed_rows GROUP BY 2 ORDER BY n DESC, c LIMIT 20) a
  UNION ALL SELECT 'tier', priority_tier, count(*) FROM seed_rows GROUP BY 2 UNION ALL SELECT 'check', k, n FROM (SELECT unnest([{'k': 'duplicate_location_id', 'n': count(nullif(location_id, '')) - count(DISTINCT nullif(location_id, ''))}, {'k': 'duplicate_unit_id', 'n': count(nullif(unit_id, '')) - count(DISTINCT nullif(unit_id, ''))}, {'k': 'missing_name', 'n': count(CASE WHEN trim(canonical_name) = '' THEN 1 END)},
    {'k': 'missing_capacity', 'n': count(*) - count(capacity_mw)}, {'k': 'capacity_nonpositive', 'n': count(CASE WHEN coalesce(capacity_mw, 0) <= 0 THEN 1 END)}, {'k': 'capacity_below_zero', 'n': count(CASE WHEN capacity_mw < 0 THEN 1 END)}, {'k': 'invalid_latitude', 'n': count(CASE WHEN latitude NOT BETWEEN -90 AND 90 THEN 1 END)}, {'k': 'invalid_longitude', 'n': count(CASE WHEN longitude NOT BETWEEN -180 AND 180 THEN 1 END)},
    {'k': 'needs_review_rows', 'n': count(CASE WHEN needs_review THEN 1 END)}, {'k': 'countries', 'n': count(DISTINCT nullif(country, ''))}, {'k': 'rows', 'n': count(*)}], recursive := true) FROM seed_rows) z""")
def _(rows):
    return dk.seed_profile(rows)


def _rate(kind: str, name: str, sql: str) -> str:
    return f"SELECT '{kind}' kind, '{name}' AS name, round({sql}, 6) AS value FROM eval_cases"


RATES = [*[("stage", c) for c in ("source_discovered", "acquisition_success", "parse_success", "extraction_success")], *[("field", c) for c in ("entity_match", "year_match", "unit_match")], ("record", "overall_pass")]


@query("bench_metrics", "eval_cases", " UNION ALL ".join([*[_rate(k, c, f"avg(CASE WHEN {c} THEN 1.0e0 ELSE 0.0e0 END)") for k, c in RATES], _rate("value", "mean", "avg(value_accuracy)"), _rate("value", "median", "median(value_accuracy)"), _rate("cases", "total", "cast(count(*) AS double)"), _rate("cases", "failed", "cast(count(CASE WHEN NOT overall_pass THEN 1 END) AS double)"),
  "SELECT 'error', error_stage, cast(count(*) AS double) FROM eval_cases WHERE error_stage IS NOT NULL GROUP BY error_stage"]))
def _(cases):
    return dk.evaluation(cases).withColumn("value", F.round("value", 6))


@query("failed_cases", "eval_cases", "SELECT case_id, error_stage FROM eval_cases WHERE NOT overall_pass")
def _(cases):
    """The cases behind the rates that did not pass."""
    return cases.where(~F.coalesce("overall_pass", F.lit(False))).select("case_id", "error_stage")


@query("global_search", "stations projects tasks", """SELECT * FROM (SELECT 'station' kind, entity_id id FROM stations WHERE lower(canonical_name) LIKE '%#00000001%' ORDER BY entity_id LIMIT 3) a UNION ALL SELECT * FROM (SELECT 'project', entity_id FROM projects WHERE lower(canonical_name) LIKE '%#00000001%' ORDER BY entity_id LIMIT 3) b
  UNION ALL SELECT * FROM (SELECT 'task', task_id FROM tasks WHERE lower(task_id) LIKE '%#00000001%' ORDER BY task_id LIMIT 3) d""")
def _(s, p, x):
    """One needle, and one that is too short to find anything."""
    groups = {"station": (s, "canonical_name", "entity_id"), "project": (p, "canonical_name", "entity_id"), "task": (x, "task_id", "task_id")}
    return dk.search_everywhere("#00000001", groups, 3).union(dk.search_everywhere("0", groups, 3))


@query("registry_stats", "stations", """SELECT 'total' dim, NULL v, count(*) n FROM stations UNION ALL SELECT 'tier', priority_tier, count(*) FROM stations GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM stations GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'country', country, count(*) n FROM stations GROUP BY 2 ORDER BY n DESC, country LIMIT 10) a""")
def _(s):
    total = s.agg(F.count("*").alias("n")).select(F.lit("total").alias("dim"), F.lit(None).cast("string").alias("v"), "n")
    return total.union(dk.top_values(s, "tier", "priority_tier")).union(dk.top_values(s, "status", "status")).union(dk.top_values(s, "country", "country", 10))


@query("project_stats", "projects", "SELECT 'status' dim, status v, count(*) n FROM projects GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'year', cast(commissioning_year AS string), count(*) FROM projects WHERE commissioning_year IS NOT NULL GROUP BY commissioning_year ORDER BY commissioning_year DESC LIMIT 10) a")
def _(p):
    years = p.where("commissioning_year is not null").groupBy("commissioning_year").agg(F.count("*").alias("n")).orderBy(F.desc("commissioning_year")).limit(10)
    return dk.top_values(p, "status", "status").union(years.select(F.lit("year"), C("commissioning_year").cast("string"), "n"))


@query("status_history", "transitions source_list", "SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY ts, seq) AS step, seq, status, title source_title FROM transitions t LEFT JOIN source_list s ON s.source_id = 'src_' || t.task_id")
def _(h, sources):
    """Each task's statuses in order of time, with the title of the source that is behind it."""
    step = F.row_number().over(Window.partitionBy("task_id").orderBy("ts", "seq"))
    return h.withColumn("step", step).join(sources.select(F.expr("substr(source_id, 5)").alias("task_id"), C("title").alias("source_title")), "task_id", "left").select("task_id", "step", "seq", "status", "source_title")


@query("discovery_list", "discoveries", "SELECT entity_id, url, place FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY CASE source_type WHEN 'official' THEN 0.9e0 ELSE 0.5e0 END DESC, updated_at DESC, url) AS place FROM discoveries WHERE status <> 'rejected') x WHERE place <= 20")
def _(d):
    """The best of each entity; of equal ones the newest."""
    score = F.when(C("source_type") == "official", 0.9).otherwise(0.5)
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc(score), F.desc("updated_at"), "url"))
    return d.where("status <> 'rejected'").withColumn("place", place).where("place <= 20").select("entity_id", "url", "place")


@query("clean_cols", "raw_rows", r"""SELECT c_custkey, nullif(trim(name), '') name, try_cast(trim(capacity) AS double) capacity, cast(trunc(try_cast(trim(latitude) AS double)) AS int) latitude, trim(status) IN ('Retired', '1') OR lower(trim(status)) IN ('yes', 'y', 't', 'true') gone, c_custkey % 2 = 0 flag, cast(1990 + c_custkey % 7 AS int) AS year FROM raw_rows""")
def _(x):
    """Text, floats, whole numbers written as floats, and yes and no in several spellings."""
    words = F.array(*map(F.lit, ("Yes", "no", "1", "0", " TRUE ", "false", "t", "n")))
    flag = F.element_at(words, (C("c_custkey") % 8 + 1).cast("int"))
    year = F.concat((1990 + C("c_custkey") % 7).cast("string"), F.lit(".0"))
    return x.select("c_custkey", tx.clean(C("name")).alias("name"), tx.clean_float(C("capacity")).alias("capacity"), tx.clean_int(C("latitude")).alias("latitude"), tx.clean_bool(F.when(C("status") == "Retired", "y").otherwise(C("status"))).alias("gone"), tx.clean_bool(flag).alias("flag"), tx.clean_int(year).alias("year"))


@query("raw_record_hash", "raw_rows", "SELECT c_custkey, sha256(coalesce(trim(location), '') || '|' || coalesce(trim(unit), '') || '|' || coalesce(trim(name), '') || '|' || coalesce(trim(capacity), '') || '|' || coalesce(trim(status), '') || '|' || coalesce(trim(country), '') || '|' || coalesce(nullif(trim(longitude), '0'), '')) hash FROM raw_rows")
def _(x):
    """Seven fields; the last is empty in some rows."""
    seven = [C(c) for c in ("location", "unit", "name", "capacity", "status", "country")] + [F.nullif(F.trim("longitude"), F.lit("0"))]
    return x.select("c_custkey", tx.raw_record_hash(seven).alias("hash"))

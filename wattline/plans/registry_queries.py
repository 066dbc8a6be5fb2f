"""Queries on the registry, links, tasks, reviews and sources."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from wattline.operators import frames as fr, lookup as lo, registry as rg, trust as t
from wattline.operators.trust import latest
from wattline.plans.registry import query

AS_OF = "2024-01-31 00:00:00"


def c(*names):
    return F.count("*").alias(*names)


@query("entity_search", "named_stations stations", """SELECT entity_id, canonical_name, count(*) OVER () total FROM (SELECT n.*, s.status, s.capacity_mw, s.country FROM named_stations n JOIN stations s ON s.entity_id = n.entity_id) x WHERE (canonical_name ILIKE '%mill 1%' OR aliases ILIKE '%mill 1%' OR coalesce(local_name, '') ILIKE '%mill 1%') AND status = 'operating' AND capacity_mw BETWEEN 10 AND 19000 ORDER BY canonical_name, entity_id LIMIT 20 OFFSET 5""")
def _(n, s):
    rows = n.join(s.select("entity_id", "status", "capacity_mw", "country"), "entity_id")
    return lo.search_entities(rows, "MILL 1", status="operating", least=10, most=19000, limit=20, offset=5).select("entity_id", "canonical_name", "total")


@query("projects_by_status", "projects", "SELECT entity_id, status, round(capacity_mw, 2) capacity_mw FROM projects WHERE status = 'approved' AND commissioning_year BETWEEN 1955 AND 2010 ORDER BY capacity_mw DESC NULLS LAST, entity_id")
def _(p):
    return lo.projects_by_status(p, "approved", first=1955, last=2010).select("entity_id", "status", F.round("capacity_mw", 2).alias("capacity_mw"))


@query("entity_by_name", "stations", "SELECT 'exact' AS how, entity_id FROM stations WHERE canonical_name = 'Customer#000000042' UNION ALL SELECT 'fuzzy', entity_id FROM stations WHERE canonical_name ILIKE '%#00000004%' OR aliases ILIKE '%#00000004%'")
def _(s):
    found = lambda how, df: df.select(F.lit(how).alias("how"), "entity_id")
    return found("exact", lo.by_name(s, "Customer#000000042")).union(found("fuzzy", lo.by_name(s, "CUSTOMER#00000004", fuzzy=True)))


@query("registry_checks", "stations", "SELECT entity_id, (latitude IS NULL OR latitude BETWEEN -90 AND 90) AND (longitude IS NULL OR longitude BETWEEN -180 AND 180) AND (capacity_mw IS NULL OR capacity_mw >= 0) ok FROM stations")
def _(s):
    free = lambda n, test: F.col(n).isNull() | test
    return s.select("entity_id", (free("latitude", F.col("latitude").between(-90, 90)) & free("longitude", F.col("longitude").between(-180, 180)) & free("capacity_mw", F.col("capacity_mw") >= 0)).alias("ok"))


@query("noise_split", "candidates", "SELECT generation_gwh IS NULL noise, count(*) n FROM candidates GROUP BY 1")
def _(x):
    return x.groupBy(F.col("generation_gwh").isNull().alias("noise")).agg(c("n"))


@query("ingest_contract", "import_rows stations", """SELECT row, array_to_string(list_filter([CASE WHEN trim(entity_id) = '' THEN 'no_entity_id' END, CASE WHEN trim(period_label) = '' THEN 'no_period_label' END, CASE WHEN trim(generation_gwh) = '' THEN 'no_generation_gwh' END, CASE WHEN trim(unit_raw) = '' THEN 'no_unit_raw' END, CASE WHEN s_id IS NULL THEN 'unknown_entity' END, CASE WHEN NOT regexp_full_match(trim(period_label), '[0-9]{4}') THEN 'period_label' END,
  CASE WHEN trim(period_type) <> 'calendar_year' THEN 'period_type' END, CASE WHEN lower(trim(value_type)) <> 'actual' THEN 'value_type' END, CASE WHEN lower(trim(measurement_scope)) <> 'plant' THEN 'measurement_scope' END, CASE WHEN lower(trim(metric)) <> 'gross_generation' THEN 'metric' END, CASE WHEN trim(generation_gwh) <> '' AND coalesce(try_cast(trim(generation_gwh) AS double), -1) < 0 THEN 'value' END,
  CASE WHEN trim(unit_raw) NOT IN ('GWh', '万千瓦时') THEN 'unit' END, CASE WHEN trim(confidence) <> '' AND NOT coalesce(try_cast(trim(confidence) AS double) BETWEEN 0 AND 1, false) THEN 'confidence' END], lambda x: x IS NOT NULL), ',') errors FROM import_rows i LEFT JOIN (SELECT entity_id s_id FROM stations) s ON s.s_id = trim(i.entity_id)""")
def _(rows, s):
    return lo.check_import(rows, s).select("row", F.array_join("errors", ",").alias("errors"))


AUTO = """FROM projects p JOIN stations s ON lower(trim(p.canonical_name)) = lower(trim(s.canonical_name)) AND p.commissioning_year = s.commissioning_year WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.project_id = p.entity_id AND l.station_id = s.entity_id)"""


@query("auto_link", "projects stations links", "SELECT p.entity_id project_id, s.entity_id station_id, cast(p.commissioning_year AS string) || '-01-01' effective_date " + AUTO)
def _(p, s, link):
    return lo.auto_link(p, s, link)


@query("station_projects", "links projects", "SELECT station_id, project_id, link_type, status FROM links l JOIN projects p ON p.entity_id = l.project_id")
def _(link, p):
    return link.join(p.select(F.col("entity_id").alias("project_id"), "status"), "project_id").select("station_id", "project_id", "link_type", "status")


@query("project_stations", "links stations", "SELECT project_id, station_id, canonical_name FROM links l JOIN stations s ON s.entity_id = l.station_id")
def _(link, s):
    return link.join(s.select(F.col("entity_id").alias("station_id"), "canonical_name"), "station_id").select("project_id", "station_id", "canonical_name")


@query("latest_link", "links", "SELECT project_id, station_id, link_type FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY effective_date DESC NULLS LAST, station_id) n FROM links) x WHERE n = 1")
def _(link):
    return latest(link, ["project_id"], F.desc_nulls_last("effective_date"), F.col("station_id")).select("project_id", "station_id", "link_type")


@query("remove_links", "links", "SELECT project_id, station_id FROM links WHERE NOT (link_type = 'expands' AND project_id LIKE 'P1%')")
def _(link):
    gone = link.where("link_type = 'expands' and project_id like 'P1%'").select("project_id", "station_id", "link_type")
    return link.join(gone, ["project_id", "station_id", "link_type"], "left_anti").select("project_id", "station_id")


@query("task_entity_name", "tasks stations projects", "SELECT task_id, coalesce(s.canonical_name, p.canonical_name) name FROM tasks t LEFT JOIN stations s ON t.entity_type = 'station' AND s.entity_id = t.entity_id LEFT JOIN projects p ON t.entity_type = 'project' AND p.entity_id = t.entity_id")
def _(t, s, p):
    names = s.select(F.lit("station").alias("entity_type"), "entity_id", "canonical_name").union(p.select(F.lit("project"), "entity_id", "canonical_name"))
    return t.join(names, ["entity_type", "entity_id"], "left").select("task_id", F.col("canonical_name").alias("name"))


@query("authority_sources", "stations", "SELECT entity_id, CASE country WHEN 'NATION_1' THEN 'https://stats.gov.example' WHEN 'NATION_2' THEN 'https://energy.gov.example' ELSE 'https://international.example' END site, CASE WHEN country IN ('NATION_1', 'NATION_2') THEN 0.95e0 ELSE 0.8e0 END reliability FROM stations")
def _(s):
    rules = s.sparkSession.createDataFrame([("NATION_1", "https://stats.gov.example", 0.95), ("NATION_2", "https://energy.gov.example", 0.95)], "country string, site string, reliability double")
    other = F.struct(F.lit("https://international.example").alias("site"), F.lit(0.8).alias("reliability"))
    return rg.by_country(s, rules, other).select("entity_id", "site", "reliability")


@query("operator_hints", "stations", "SELECT entity_id, CASE WHEN country IN ('NATION_1', 'NATION_3') AND canonical_name LIKE '%1%' THEN 'first' WHEN country IN ('NATION_1', 'NATION_4') AND canonical_name LIKE '%2%' THEN 'second' END hint FROM stations")
def _(s):
    rules = s.sparkSession.createDataFrame([(1, "NATION_1", "1", "first"), (1, "NATION_3", "1", "first"), (2, "NATION_1", "2", "second"), (2, "NATION_4", "2", "second")], "n int, country string, word string, hint string")
    return rg.first_hint(s, rules, "entity_id", "canonical_name")


@query("identity_profile", "stations publisher_sources discoveries", r"""WITH_ known AS (SELECT entity_id, url, 0 r, n FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY last_success DESC NULLS LAST, url) n FROM publisher_sources WHERE source_type = 'official' AND success_count > 0) x WHERE n <= 8
    UNION ALL SELECT entity_id, url, 1, n FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY updated_at DESC NULLS LAST, url) n FROM discoveries WHERE source_type = 'official' AND status = 'accepted') y WHERE n <= 8),
  sites AS (SELECT entity_id, string_agg(site, ',' ORDER BY r, n) domains FROM (SELECT entity_id, site, min(r) r, arg_min(n, (r, n)) n FROM (SELECT *, regexp_replace(regexp_extract(url, '^https://([^/]+)', 1), '^www\.', '') site FROM known) k GROUP BY entity_id, site) z GROUP BY entity_id),
  entries AS (SELECT entity_id, string_agg(url, ',' ORDER BY r, n) urls FROM (SELECT entity_id, url, min(r) r, arg_min(n, (r, n)) n FROM known GROUP BY entity_id, url) k GROUP BY entity_id),
  pubs AS (SELECT p.entity_id, string_agg(DISTINCT 'publisher_' || substr(sha256(regexp_replace(regexp_extract(url, '^https://([^/]+)', 1), '^www\.', '') || chr(31) || lower(country)), 1, 20), ',' ORDER BY 'publisher_' || substr(sha256(regexp_replace(regexp_extract(url, '^https://([^/]+)', 1), '^www\.', '') || chr(31) || lower(country)), 1, 20)) ids
    FROM publisher_sources p JOIN stations s ON s.entity_id = p.entity_id WHERE source_type = 'official' AND success_count > 0 GROUP BY p.entity_id)
  SELECT s.entity_id, coalesce(domains, '') domains, coalesce(urls, '') urls, coalesce(ids, '') publishers, canonical_name || '|' || lower(operator) AS names FROM stations s LEFT JOIN sites d ON d.entity_id = s.entity_id LEFT JOIN entries e ON e.entity_id = s.entity_id LEFT JOIN pubs p ON p.entity_id = s.entity_id""".replace("WITH_", ","))
def _(s, o, d):
    out = rg.identity_profiles(s, o, d, rg.publisher_profiles(o, s)[1])
    joined = lambda c, by: F.array_join(c, by)
    return out.select("entity_id", joined("official_domains", ",").alias("domains"), joined("official_entry_urls", ",").alias("urls"), joined("publisher_profile_ids", ",").alias("publishers"), joined("names", "|").alias("names"))


@query("countries", "stations", "SELECT country, count(*) n FROM stations WHERE country <> '' GROUP BY country")
def _(s):
    return s.where("country <> ''").groupBy("country").agg(c("n"))


@query("link_stats", "links", "SELECT link_type, count(*) n, count(DISTINCT project_id) projects, count(DISTINCT station_id) stations FROM links GROUP BY link_type")
def _(link):
    return link.groupBy("link_type").agg(c("n"), F.count_distinct("project_id").alias("projects"), F.count_distinct("station_id").alias("stations"))


@query("dashboard_cards", "stations projects records", "SELECT (SELECT count(*) FROM stations) stations, (SELECT count(*) FROM projects) projects, (SELECT count(*) FROM records WHERE publication_status = 'publishable') published")
def _(s, p, r):
    return s.agg(c("stations")).crossJoin(p.agg(c("projects"))).crossJoin(r.agg(F.count_if(F.col("publication_status") == "publishable").alias("published")))  # single rows


@query("dashboard_quality", "records", "SELECT count(*) total, count(CASE WHEN validation_status = 'passed' THEN 1 END) passed, count(CASE WHEN evidence_id IS NULL THEN 1 END) no_evidence FROM records")
def _(r):
    return r.agg(c("total"), F.count_if(F.col("validation_status") == "passed").alias("passed"), F.count_if(F.col("evidence_id").isNull()).alias("no_evidence"))


@query("dashboard_todo", "tasks reviews", "SELECT (SELECT count(*) FROM tasks WHERE status NOT IN ('success', 'cancelled')) open_tasks, (SELECT count(*) FROM tasks WHERE status = 'failed') failed, (SELECT count(*) FROM reviews WHERE status = 'open') reviews")
def _(t, r):
    return t.agg(F.count_if(~F.col("status").isin("success", "cancelled")).alias("open_tasks"), F.count_if(F.col("status") == "failed").alias("failed")).crossJoin(r.agg(F.count_if(F.col("status") == "open").alias("reviews")))


@query("system_info", "archive records tasks", "SELECT (SELECT count(*) FROM archive) documents, (SELECT cast(coalesce(sum(file_size), 0) AS bigint) FROM archive) bytes, (SELECT count(*) FROM records) records, (SELECT count(*) FROM tasks) tasks")
def _(a, r, t):
    return a.agg(c("documents"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes")).crossJoin(r.agg(c("records"))).crossJoin(t.agg(c("tasks")))


@query("review_queue_stats", "reviews", "SELECT status, fact_type, count(*) n FROM reviews GROUP BY status, fact_type")
def _(r):
    return r.groupBy("status", "fact_type").agg(c("n"))


@query("task_stats", "tasks", "SELECT status, failure_stage, count(*) n, round(avg(attempts), 4) attempts FROM tasks GROUP BY status, failure_stage")
def _(t):
    return t.groupBy("status", "failure_stage").agg(c("n"), F.round(F.avg("attempts"), 4).alias("attempts"))


@query("source_usage", "sources archive records", "SELECT s.source_id, count(DISTINCT a.document_id) documents, count(DISTINCT r.id) records FROM (SELECT DISTINCT source_id FROM sources) s LEFT JOIN archive a ON a.source_id = s.source_id LEFT JOIN records r ON r.source_id = s.source_id GROUP BY s.source_id")
def _(s, a, r):
    return fr.usage(s.select("source_id").distinct(), "source_id", {"documents": a, "records": r})


@query("document_usage", "archive evidence candidates", "SELECT a.document_id, (SELECT count(*) FROM evidence e WHERE e.document_id = a.document_id) evidence, (SELECT count(*) FROM candidates c WHERE c.document_id = a.document_id) candidates FROM archive a")
def _(a, e, x):
    return fr.usage(a.select("document_id"), "document_id", {"evidence": e, "candidates": x})


@query("evidence_usage", "evidence candidate_evidence records", "SELECT e.evidence_id, count(DISTINCT ce.candidate_id) candidates, count(DISTINCT r.id) records FROM evidence e LEFT JOIN candidate_evidence ce ON ce.evidence_id = e.evidence_id LEFT JOIN records r ON r.evidence_id = e.evidence_id GROUP BY e.evidence_id")
def _(e, ce, r):
    return fr.usage(e.select("evidence_id"), "evidence_id", {"candidates": ce, "records": r})


@query("publisher_summary", "sources", r"SELECT regexp_extract(url, '^https?://(?:www\.)?([^/]+)', 1) domain, count(*) n, string_agg(DISTINCT source_type, ',' ORDER BY source_type) kinds FROM sources GROUP BY 1")
def _(s):
    return s.groupBy(F.regexp_extract("url", r"^https?://(?:www\.)?([^/]+)", 1).alias("domain")).agg(c("n"), F.array_join(F.sort_array(F.collect_set("source_type")), ",").alias("kinds"))


SEEN = r"""(SELECT p.*, country, regexp_replace(regexp_extract(url, '^https://([^/]+)', 1), '^www\.', '') site, regexp_replace(regexp_replace(url, '^https://[^/]+', ''), '[0-9]{4}', '{year}') path FROM publisher_sources p JOIN stations s ON s.entity_id = p.entity_id WHERE source_type = 'official' AND success_count > 0)"""


@query("publisher_profiles", "publisher_sources stations", f"""SELECT 'publisher_' || substr(sha256(a.site || chr(31) || lower(a.country)), 1, 20) id, a.site AS domain, a.country, canonical_name, language, round(reliability, 4) reliability, successes, last_success, paths, 'site:' || a.site || ' ' || canonical_name || ' {{year}} annual report' pattern FROM
  (SELECT site, country, arg_min(coalesce(nullif(trim(publisher), ''), site), (last_success, source_id)) canonical_name, arg_max(language, (last_success, source_id)) FILTER (WHERE language IS NOT NULL) language, max(greatest(0.0e0, least(1.0e0, source_reliability_score))) reliability, max(success_count) successes, max(last_success) last_success FROM {SEEN} x GROUP BY site, country) a
  JOIN (SELECT site, country, string_agg(path, ',' ORDER BY n) paths FROM (SELECT *, row_number() OVER (PARTITION BY site, country ORDER BY seen, path) n FROM (SELECT site, country, path, min((last_success, source_id)) seen FROM {SEEN} x GROUP BY site, country, path) y) z WHERE n <= 12 GROUP BY site, country) b ON b.site = a.site AND b.country = a.country""")
def _(o, s):
    out = rg.publisher_profiles(o, s)[0]
    return out.select(F.col("publisher_profile_id").alias("id"), "domain", "country", "canonical_name", "language", F.round("reliability_score", 4).alias("reliability"), F.col("success_count").alias("successes"), "last_success", F.array_join("report_paths", ",").alias("paths"), F.col("search_pattern").alias("pattern"))


@query("source_reliability", "events", """SELECT user_id, round(list_reduce(list_prepend(0.5e0, list(CASE WHEN event_type = 'error' THEN -0.1e0 ELSE 0.05e0 END ORDER BY ts, event_id)), lambda a, x: CASE WHEN x > 0 THEN least(1.0e0, a + x) ELSE greatest(0.0e0, a + x) END), 6) score,
  count(CASE WHEN event_type <> 'error' THEN 1 END) success_count, count(CASE WHEN event_type = 'error' THEN 1 END) failure_count, max(CASE WHEN event_type <> 'error' THEN ts END) last_success, max(CASE WHEN event_type = 'error' THEN ts END) last_failure FROM events WHERE event_type <> 'signup' GROUP BY user_id""")
def _(e):
    out = fr.fold_reliability(e.where("event_type <> 'signup'"), "user_id", ["ts", "event_id"], F.col("event_type") != "error")
    return out.withColumn("score", F.round("score", 6))


CANON_FOUND = "regexp_replace(regexp_replace(lower(regexp_replace(url, '[?].*$', '')), '([^:])/+', '\\1/', 'g'), '/$', '')"


@query("holdout_score", "found_urls gold_urls", f"""SELECT count(*) total_cases, count(CASE WHEN label_status <> 'pending' THEN 1 END) reviewed, count(CASE WHEN label_status = 'confirmed_hit' THEN 1 END) hits, count(CASE WHEN label_status = 'confirmed_no_hit' THEN 1 END) no_hits, count(CASE WHEN label_status = 'confirmed_hit' AND matched > 0 THEN 1 END) matched_hits,
  cast(sum(CASE WHEN label_status <> 'pending' THEN n ELSE 0 END) AS bigint) qualified, cast(sum(CASE WHEN label_status <> 'pending' THEN matched ELSE 0 END) AS bigint) matched, count(CASE WHEN label_status = 'pending' THEN 1 END) = 0 gate_open FROM
  (SELECT g.case_id, g.label_status, count(f.url) n, count(CASE WHEN f.url = rtrim(g.url, '/') THEN 1 END) matched FROM gold_urls g LEFT JOIN (SELECT case_id, {CANON_FOUND} url FROM found_urls) f ON f.case_id = g.case_id GROUP BY g.case_id, g.label_status) x""")
def _(found, gold):
    rows = gold.groupBy("case_id", "label_status").agg(F.collect_set("url").alias("gold_urls"))
    return t.holdout_score(found, rows).select("total_cases", "reviewed", "hits", "no_hits", "matched_hits", "qualified", "matched", "gate_open")


@query("provider_usage", "events", "SELECT user_id % 10 provider, count(*) calls, count(CASE WHEN event_type = 'purchase' THEN 1 END) successes, count(CASE WHEN event_type = 'view' THEN 1 END) empty_calls, count(CASE WHEN event_type = 'error' THEN 1 END) failures, round(sum(value), 2) cost FROM events GROUP BY 1")
def _(e):
    k = lambda v: F.count_if(F.col("event_type") == v)
    return e.groupBy((F.col("user_id") % 10).alias("provider")).agg(c("calls"), k("purchase").alias("successes"), k("view").alias("empty_calls"), k("error").alias("failures"), F.round(F.sum("value"), 2).alias("cost"))


@query("attempt_no", "sources tasks", """SELECT t.task_id, coalesce(success_count + failure_count, 0) + row_number() OVER (PARTITION BY t.entity_id ORDER BY t.created_at, t.task_id) attempt_no FROM tasks t LEFT JOIN (SELECT entity_id, sum(success_count) success_count, sum(failure_count) failure_count FROM sources GROUP BY entity_id) o ON o.entity_id = t.entity_id""")
def _(o, x):
    """Tasks are new attempts of their entity; its sources count the attempts that there were."""
    before = o.groupBy("entity_id").agg(F.sum(F.col("success_count") + F.col("failure_count")).alias("m"))
    k = F.row_number().over(Window.partitionBy("entity_id").orderBy("created_at", "task_id"))
    return x.withColumn("k", k).join(before, "entity_id", "left").select("task_id", (F.coalesce("m", F.lit(0)) + F.col("k")).cast("long").alias("attempt_no"))


@query("latest_run", "transitions", "SELECT task_id, status, seq FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) n FROM transitions) x WHERE n = 1")
def _(h):
    return latest(h, ["task_id"], F.desc("seq")).select("task_id", "status", "seq")


LEGAL = " OR ".join(f"(b = '{k}' AND status IN ({', '.join(repr(x) for x in v)}))" for k, v in fr.TRANSITIONS.items() if v)


@query("illegal_transitions", "transitions", f"SELECT task_id, seq, b AS before, status FROM (SELECT *, lag(status) OVER (PARTITION BY task_id ORDER BY ts, seq) b FROM transitions) x WHERE b IS NOT NULL AND b <> status AND NOT ({LEGAL})")
def _(h):
    return fr.illegal_transitions(h, "task_id", ["ts", "seq"]).select("task_id", "seq", "before", "status")


BEST = """SELECT '{0}' AS mode, task_id, url, rank FROM (SELECT t.task_id, s.url, row_number() OVER (PARTITION BY t.task_id ORDER BY CASE WHEN covered_year IS NOT NULL THEN 0 ELSE 1 END, source_reliability_score DESC, last_success DESC NULLS LAST, source_id, url) AS rank
  FROM source_tasks t JOIN station_sources s ON s.entity_id = t.entity_id AND covered_metric = metric WHERE (covered_year IS NULL OR covered_year = year) AND NOT (failure_count >= 3 AND last_failure IS NOT NULL AND floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(last_failure)) / 86400) < 7) {1}) x WHERE rank <= {2}"""
VERIFIED = "AND success_count > 0 AND last_success IS NOT NULL AND floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(last_success)) / 86400) <= 90"


@query("best_sources", "station_sources source_tasks", BEST.format("any", "", 5) + " UNION ALL " + BEST.format("verified", VERIFIED, 2))
def _(s, tasks):
    """The five best sources of each task, and the two best that were verified lately; metrics, years, failures and ties vary."""
    as_of = F.lit(AS_OF).cast("timestamp")
    found = [fr.best_sources(s, tasks, as_of, k, only).select(F.lit(mode).alias("mode"), "task_id", "url", "rank") for mode, k, only in (("any", 5, False), ("verified", 2, True))]
    return found[0].union(found[1])


@query("entity_sources", "sources", "SELECT entity_id, url FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY source_reliability_score DESC, last_success DESC NULLS LAST, url) n FROM sources) x WHERE n <= 10")
def _(s):
    w = Window.partitionBy("entity_id").orderBy(F.desc("source_reliability_score"), F.desc_nulls_last("last_success"), "url")
    return s.withColumn("n", F.row_number().over(w)).where("n <= 10").select("entity_id", "url")


@query("station_picker", "stations named_stations", "SELECT s.entity_id, country, coalesce(nullif(trim(local_name), ''), n.canonical_name) label FROM stations s JOIN named_stations n ON n.entity_id = s.entity_id ORDER BY CASE country WHEN 'NATION_1' THEN 0 WHEN 'NATION_2' THEN 1 ELSE 2 END, capacity_mw DESC NULLS LAST, n.canonical_name, s.entity_id LIMIT 50")
def _(s, n):
    return lo.station_picker(s.join(n.select("entity_id", "local_name"), "entity_id"), ["NATION_1", "NATION_2"], 50).select("entity_id", "country", "label")


@query("pending_queue", "tasks", "SELECT task_id FROM tasks WHERE status = 'pending' ORDER BY priority_tier, collection_priority NULLS LAST, created_at, task_id LIMIT 100")
def _(t):
    return t.where("status = 'pending'").orderBy("priority_tier", F.asc_nulls_last("collection_priority"), "created_at", "task_id").limit(100).select("task_id")


@query("gap_worklist", "tasks", "SELECT task_id FROM tasks WHERE status NOT IN ('success', 'cancelled') ORDER BY collection_priority NULLS LAST, updated_at DESC, task_id LIMIT 100")
def _(t):
    return t.where("status not in ('success', 'cancelled')").orderBy(F.asc_nulls_last("collection_priority"), F.desc("updated_at"), "task_id").limit(100).select("task_id")


@query("review_queue_cli", "reviews", "SELECT review_id FROM reviews WHERE status = 'open' ORDER BY created_at DESC, review_id LIMIT 50")
def _(r):
    return r.where("status = 'open'").orderBy(F.desc("created_at"), "review_id").limit(50).select("review_id")


@query("paged", "stations", "SELECT entity_id, count(*) OVER () total FROM stations ORDER BY canonical_name, entity_id LIMIT 25 OFFSET 75")
def _(s):
    return lo.paged(s, ["canonical_name", "entity_id"], 25, 75).select("entity_id", "total")


@query("sample_cases", "stations", "SELECT entity_id, y.year FROM (SELECT entity_id FROM stations WHERE capacity_mw > 100 ORDER BY md5('7' || entity_id), entity_id LIMIT 30) s CROSS JOIN (SELECT unnest(['1996', '1997', '1998']) AS year) y")
def _(s):
    chosen = s.where("capacity_mw > 100").orderBy(F.md5(F.concat(F.lit("7"), "entity_id").cast("binary")), "entity_id").limit(30)
    return chosen.select("entity_id", F.explode(F.array(*map(F.lit, ("1996", "1997", "1998")))).alias("year"))

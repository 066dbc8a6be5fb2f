"""Queries on the trusted set: chain, rankings, coverage, gaps, accuracy."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from wattline.operators import lookup as lo, trust as t
from wattline.plans.registry import query

YEARS = [str(y) for y in range(1995, 2002)]
CHAIN = "records candidates candidate_evidence evidence archive"
RULE = """value_type = 'actual' AND period_type = 'calendar_year' AND measurement_scope = 'plant' AND metric = 'gross_generation' AND normalized_unit = 'gwh'
  AND validation_status = 'passed' AND publication_status = 'publishable' AND review_status = 'approved' AND evidence_id IS NOT NULL AND confidence >= 0.7e0"""
CHAIN_SQL = """chain AS (SELECT r.* FROM records r JOIN candidates c ON r.candidate_id = c.candidate_id AND r.entity_id = c.entity_id AND r.period_type = c.period_type
  AND r.period_label = c.period_label AND r.value_type = c.value_type AND r.measurement_scope = c.measurement_scope AND r.metric = c.metric
  AND r.normalized_unit = c.normalized_unit AND r.generation_gwh = c.generation_gwh JOIN candidate_evidence ce ON ce.candidate_id = r.candidate_id AND ce.evidence_id = r.evidence_id
  JOIN evidence e ON e.evidence_id = r.evidence_id JOIN archive d ON d.document_id = c.document_id AND d.document_id = e.document_id AND d.content_hash = e.content_hash)"""
TRUSTED_SQL = f", trusted AS (SELECT * FROM records WHERE {RULE}) "
CHAINED = f", {CHAIN_SQL}, ok AS (SELECT * FROM chain WHERE {RULE}) "


def ok(*frames):
    return t.trusted(t.trusted_chain(*frames))


@query("trusted_filter", "records", f"SELECT id, entity_id, period_label, round(generation_gwh, 4) gwh FROM records WHERE {RULE}")
def _(r):
    return t.trusted(r).select("id", "entity_id", "period_label", F.round("generation_gwh", 4).alias("gwh"))


@query("trust_violations", "records", """SELECT id, array_to_string(list_filter([CASE WHEN value_type <> 'actual' THEN 'value_type' END, CASE WHEN period_type <> 'calendar_year' THEN 'period_type' END, CASE WHEN measurement_scope <> 'plant' THEN 'measurement_scope' END, CASE WHEN metric <> 'gross_generation' THEN 'metric' END, CASE WHEN normalized_unit <> 'gwh' THEN 'normalized_unit' END,
  CASE WHEN validation_status <> 'passed' THEN 'validation_status' END, CASE WHEN publication_status <> 'publishable' THEN 'publication_status' END, CASE WHEN review_status <> 'approved' THEN 'review_status' END,
  CASE WHEN evidence_id IS NULL THEN 'evidence_id' END, CASE WHEN confidence >= 0.7e0 THEN NULL ELSE 'confidence' END], lambda x: x IS NOT NULL), ',') violations FROM records""")
def _(r):
    return t.trust_violations(r).select("id", F.array_join("violations", ",").alias("violations"))


@query("trusted_chain", CHAIN, f", {CHAIN_SQL} SELECT id, entity_id, period_label, round(generation_gwh, 4) gwh FROM chain")
def _(*f):
    return t.trusted_chain(*f).select("id", "entity_id", "period_label", F.round("generation_gwh", 4).alias("gwh"))


@query("rank_by_year", CHAIN, CHAINED + "SELECT id, entity_id, period_label, round(generation_gwh, 4) gwh, row_number() OVER (PARTITION BY period_label ORDER BY generation_gwh DESC, entity_id, id) AS rank FROM ok")
def _(*f):
    rows = ok(*f).select("id", "entity_id", "period_label", "generation_gwh")
    return t.rank_by(rows, "period_label").select("id", "entity_id", "period_label", F.round("generation_gwh", 4).alias("gwh"), "rank")


@query("rank_by_country", CHAIN + " stations", CHAINED + """SELECT * FROM (SELECT id, ok.entity_id, country, round(generation_gwh, 4) gwh, row_number() OVER (PARTITION BY country ORDER BY generation_gwh DESC, ok.entity_id, id) AS rank
  FROM ok JOIN stations s ON s.entity_id = ok.entity_id WHERE period_label = '1998') x WHERE rank <= 10""")
def _(r, c, ce, e, d, s):
    rows = ok(r, c, ce, e, d).where("period_label = '1998'").join(s.select("entity_id", "country"), "entity_id")
    return t.rank_by(rows, "country", k=10).select("id", "entity_id", "country", F.round("generation_gwh", 4).alias("gwh"), "rank")


@query("top_n", CHAIN + " stations", CHAINED + """SELECT id, ok.entity_id, canonical_name, country, round(generation_gwh, 4) gwh, row_number() OVER (ORDER BY generation_gwh DESC, ok.entity_id, id) AS rank
  FROM ok JOIN stations s ON s.entity_id = ok.entity_id WHERE period_label = '1998' ORDER BY rank LIMIT 100""")
def _(r, c, ce, e, d, s):
    return t.top_n(ok(r, c, ce, e, d), "1998").join(s.select("entity_id", "canonical_name", "country"), "entity_id").select("id", "entity_id", "canonical_name", "country", F.round("generation_gwh", 4).alias("gwh"), "rank")


@query("top100_latest", CHAIN + " stations", CHAINED + """SELECT id, ok.entity_id, round(capacity_mw, 2) capacity_mw, round(generation_gwh, 4) gwh FROM ok JOIN stations s ON s.entity_id = ok.entity_id
  WHERE period_label = (SELECT max(period_label) FROM ok) ORDER BY generation_gwh DESC, ok.entity_id, id LIMIT 100""")
def _(r, c, ce, e, d, s):
    rows = ok(r, c, ce, e, d)
    newest = rows.agg(F.max("period_label").alias("period_label"))
    best = rows.join(F.broadcast(newest), "period_label").orderBy(F.desc("generation_gwh"), "entity_id", "id").limit(100)
    return best.join(s.select("entity_id", "capacity_mw"), "entity_id").select("id", "entity_id", F.round("capacity_mw", 2).alias("capacity_mw"), F.round("generation_gwh", 4).alias("gwh"))


@query("ranking_summary", CHAIN + " stations", CHAINED + """SELECT round(sum(generation_gwh), 2) total_gwh, round(avg(generation_gwh), 4) mean_gwh, count(DISTINCT country) countries
  FROM (SELECT * FROM ok WHERE period_label = '1998' ORDER BY generation_gwh DESC, entity_id, id LIMIT 100) o JOIN stations s ON s.entity_id = o.entity_id""")
def _(r, c, ce, e, d, s):
    rows = t.top_n(ok(r, c, ce, e, d), "1998").join(s.select("entity_id", "country"), "entity_id")
    return rows.agg(F.round(F.sum("generation_gwh"), 2).alias("total_gwh"), F.round(F.avg("generation_gwh"), 4).alias("mean_gwh"), F.count_distinct("country").alias("countries"))


@query("year_stats", "records stations", TRUSTED_SQL + """SELECT count(*) records, count(DISTINCT t.entity_id) stations, count(DISTINCT country) countries, round(sum(generation_gwh), 2) gwh, round(avg(generation_gwh), 4) mean_gwh,
  round(coalesce(sum(generation_gwh) / 1000, 0), 4) twh FROM trusted t JOIN stations s ON s.entity_id = t.entity_id WHERE period_label = '1998'""")
def _(r, s):
    rows = t.trusted(r, year="1998").join(s.select("entity_id", "country"), "entity_id")
    gwh = F.sum("generation_gwh")
    return rows.agg(F.count("*").alias("records"), F.count_distinct("entity_id").alias("stations"), F.count_distinct("country").alias("countries"), F.round(gwh, 2).alias("gwh"), F.round(F.avg("generation_gwh"), 4).alias("mean_gwh"), F.round(F.coalesce(gwh / 1000, F.lit(0.0)), 4).alias("twh"))


@query("coverage_by_year", "records", TRUSTED_SQL + "SELECT period_label, count(*) records FROM trusted GROUP BY period_label")
def _(r):
    return t.trusted(r).groupBy("period_label").agg(F.count("*").alias("records"))


@query("coverage_stats_country", "records stations", TRUSTED_SQL + """SELECT country, count(DISTINCT s.entity_id) total, count(DISTINCT t.entity_id) with_data, count(t.id) records FROM stations s LEFT JOIN trusted t ON t.entity_id = s.entity_id
  GROUP BY country ORDER BY with_data DESC, country LIMIT 20""")
def _(r, s):
    per = t.trusted(r).groupBy("entity_id").agg(F.count("*").alias("n"))
    joined = s.select("entity_id", "country").join(per, "entity_id", "left")
    return joined.groupBy("country").agg(F.count("*").alias("total"), F.count("n").alias("with_data"), F.coalesce(F.sum("n"), F.lit(0)).alias("records")).orderBy(F.desc("with_data"), "country").limit(20)


@query("coverage_stats_year", "records", TRUSTED_SQL + "SELECT period_label, count(DISTINCT entity_id) stations, count(*) records FROM trusted GROUP BY period_label ORDER BY period_label DESC LIMIT 15")
def _(r):
    return t.trusted(r).groupBy("period_label").agg(F.count_distinct("entity_id").alias("stations"), F.count("*").alias("records")).orderBy(F.desc("period_label")).limit(15)


@query("coverage_stats_overall", "records stations", TRUSTED_SQL + "SELECT (SELECT count(*) FROM stations) stations, (SELECT count(DISTINCT entity_id) FROM trusted) with_data, (SELECT count(*) FROM trusted) records")
def _(r, s):
    have = t.trusted(r).agg(F.count_distinct("entity_id").alias("with_data"), F.count("*").alias("records"))
    return s.agg(F.count("*").alias("stations")).crossJoin(have)  # two single rows


@query("coverage_semi", CHAIN + " stations", CHAINED + "SELECT country, count(DISTINCT s.entity_id) stations FROM stations s WHERE EXISTS (SELECT 1 FROM ok WHERE ok.entity_id = s.entity_id) GROUP BY country")
def _(r, c, ce, e, d, s):
    return s.join(ok(r, c, ce, e, d), "entity_id", "left_semi").groupBy("country").agg(F.count("*").alias("stations"))


@query("data_coverage", "records stations", TRUSTED_SQL + """SELECT country, period_label, count(DISTINCT t.entity_id) with_data, count(DISTINCT s.entity_id) total, round(100.0e0 * count(DISTINCT t.entity_id) / count(DISTINCT s.entity_id), 1) pct
  FROM stations s LEFT JOIN trusted t ON t.entity_id = s.entity_id GROUP BY country, period_label""")
def _(r, s):
    rows = s.select("entity_id", "country").join(t.trusted(r).select(F.col("entity_id"), "period_label", F.lit(1).alias("has")).distinct(), "entity_id", "left")
    return rows.groupBy("country", "period_label").agg(F.count("has").alias("with_data"), F.count("*").alias("total"), F.round(100.0 * F.count("has") / F.count("*"), 1).alias("pct"))


@query("coverage_matrix", "records stations", TRUSTED_SQL + """, n AS (SELECT country, count(*) total FROM stations GROUP BY country) SELECT n.country, period_label, count(DISTINCT t.entity_id) with_data, total, round(100.0e0 * count(DISTINCT t.entity_id) / total, 1) pct
  FROM trusted t JOIN stations s ON s.entity_id = t.entity_id JOIN n ON n.country = s.country GROUP BY n.country, period_label, total""")
def _(r, s):
    total = s.groupBy("country").agg(F.count("*").alias("total"))
    have = t.trusted(r).join(s.select("entity_id", "country"), "entity_id").groupBy("country", "period_label").agg(F.count_distinct("entity_id").alias("with_data"))
    return have.join(total, "country").select("country", "period_label", "with_data", "total", F.round(100.0 * F.col("with_data") / F.col("total"), 1).alias("pct"))


RATE_SQL = TRUSTED_SQL + ", rate AS (SELECT country, 100.0e0 * count(DISTINCT t.entity_id) / count(DISTINCT s.entity_id) rate, count(DISTINCT t.entity_id) n FROM stations s LEFT JOIN trusted t ON t.entity_id = s.entity_id GROUP BY country) "


def _rate(r, s):
    have = t.trusted(r).select("entity_id").distinct().withColumn("has", F.lit(1))
    return s.join(have, "entity_id", "left").groupBy("country").agg((100.0 * F.count("has") / F.count("*")).alias("rate"), F.count("has").alias("n"))


@query("coverage_buckets", "records stations", RATE_SQL + "SELECT cast(least(floor(rate / 20), 4) AS bigint) bucket, count(*) countries FROM rate GROUP BY 1")
def _(r, s):
    return _rate(r, s).groupBy(F.least(F.floor(F.col("rate") / 20), F.lit(4)).cast("long").alias("bucket")).agg(F.count("*").alias("countries"))


@query("top5_others", "records stations", RATE_SQL + "SELECT label, cast(sum(n) AS bigint) n FROM (SELECT CASE WHEN row_number() OVER (ORDER BY n DESC, country) <= 5 THEN country ELSE 'others' END label, n FROM rate) x GROUP BY label")
def _(r, s):
    ranked = _rate(r, s).withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "country")))  # one row for each country
    return ranked.groupBy(F.when(F.col("k") <= 5, F.col("country")).otherwise("others").alias("label")).agg(F.sum("n").alias("n"))


GAPS_SQL = TRUSTED_SQL + ", years AS (SELECT unnest(['1995','1996','1997','1998','1999','2000','2001']) period_label) "
GAP = "NOT EXISTS (SELECT 1 FROM trusted t WHERE t.entity_id = s.entity_id AND t.period_label = y.period_label)"


@query("detect_gaps", "stations records", GAPS_SQL + f"SELECT s.entity_id, y.period_label, CASE WHEN capacity_mw >= 10000 THEN 'high' ELSE 'medium' END priority FROM (SELECT * FROM stations WHERE capacity_mw >= 1000 ORDER BY capacity_mw DESC, entity_id LIMIT 500) s CROSS JOIN years y WHERE {GAP}")
def _(s, r):
    return t.detect_gaps(s, t.trusted(r), YEARS, 1000, 500).select("entity_id", "period_label", "priority")


@query("gap_count", "stations records", GAPS_SQL + f"SELECT count(*) gaps FROM stations s CROSS JOIN years y WHERE capacity_mw >= 10000 AND {GAP}")
def _(s, r):
    return t.detect_gaps(s, t.trusted(r), YEARS, 10000).agg(F.count("*").alias("gaps"))


@query("gap_page", "stations records", GAPS_SQL + f"SELECT s.entity_id, y.period_label, round(capacity_mw, 2) capacity_mw FROM stations s CROSS JOIN years y WHERE capacity_mw >= 1000 AND {GAP} ORDER BY CASE WHEN capacity_mw >= 10000 THEN 0 ELSE 1 END, s.capacity_mw DESC, s.entity_id, y.period_label LIMIT 100")
def _(s, r):
    gaps = t.detect_gaps(s, t.trusted(r), YEARS, 1000)
    return gaps.orderBy(F.when(F.col("priority") == "high", 0).otherwise(1), F.desc("capacity_mw"), "entity_id", "period_label").limit(100).select("entity_id", "period_label", F.round("capacity_mw", 2).alias("capacity_mw"))


@query("latest_record", "records", "SELECT id, entity_id, period_label FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, period_label ORDER BY created_at DESC, id DESC) n FROM records) x WHERE n = 1")
def _(r):
    return t.latest(r, ["entity_id", "period_label"], F.desc("created_at"), F.desc("id")).select("id", "entity_id", "period_label")


@query("gt_match", "ground_truth records", """, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, period_label ORDER BY created_at DESC, id DESC) n FROM records WHERE value_type = 'actual') x WHERE n = 1)
  SELECT case_id, CASE WHEN generation_gwh IS NULL THEN 'missing' WHEN abs(generation_gwh - expected) / expected <= 0.05e0 THEN 'matched' ELSE 'mismatched' END status, round(abs(generation_gwh - expected) / expected * 100, 4) diff_pct
  FROM ground_truth g LEFT JOIN newest n ON n.entity_id = g.entity_id AND n.period_label = g.period_label""")
def _(g, r):
    return t.ground_truth(g, r).select("case_id", "status", "diff_pct")


ACC = "CASE WHEN e IS NULL THEN NULL WHEN e <= 0.05e0 THEN 1.0e0 WHEN e <= 0.1e0 THEN 0.9e0 WHEN e <= 0.2e0 THEN 0.7e0 ELSE greatest(0.0e0, 1 - e) END"


@query("value_accuracy", "ground_truth records", f"SELECT case_id, round(CASE WHEN expected = 0 THEN CASE WHEN actual = 0 THEN 1.0e0 ELSE 0.0e0 END ELSE {ACC} END, 4) accuracy FROM (SELECT *, abs(actual - expected) / nullif(expected, 0) e FROM (SELECT case_id, CASE WHEN case_id % 15 < 10 THEN expected ELSE 0.0e0 END expected, CASE WHEN case_id % 45 < 20 THEN generation_gwh ELSE 0.0e0 END actual FROM ground_truth g JOIN records r ON r.id = g.case_id) x) y")
def _(g, r):
    """Among the cases are some where nothing is expected and some where nothing was found."""
    zero = F.lit(0.0)
    acc = lo.value_accuracy(F.when(F.col("case_id") % 15 < 10, F.col("expected")).otherwise(zero), F.when(F.col("case_id") % 45 < 20, F.col("generation_gwh")).otherwise(zero))
    return g.join(r, g.case_id == r.id).select("case_id", F.round(acc, 4).alias("accuracy"))


@query("bench_legacy", "ground_truth records", """SELECT count(*) cases, round(100.0e0 * count(generation_gwh) / count(*), 4) coverage_pct, count(CASE WHEN abs(generation_gwh - expected) < 0.1e0 THEN 1 END) exact, count(CASE WHEN abs(generation_gwh - expected) / expected < 0.05e0 THEN 1 END) close,
  round(avg(abs(generation_gwh - expected) / expected * 100), 4) mean_error_pct FROM ground_truth g LEFT JOIN (SELECT * FROM records WHERE publication_status = 'publishable') r ON r.id = g.case_id""")
def _(g, r):
    rows = g.join(r.where("publication_status = 'publishable'").select("id", "generation_gwh"), F.col("id") == F.col("case_id"), "left")
    d = F.abs(F.col("generation_gwh") - F.col("expected"))
    rel = d / F.col("expected")
    return rows.agg(F.count("*").alias("cases"), F.round(100.0 * F.count("generation_gwh") / F.count("*"), 4).alias("coverage_pct"), F.count_if(d < 0.1).alias("exact"), F.count_if(rel < 0.05).alias("close"), F.round(F.avg(rel * 100), 4).alias("mean_error_pct"))


@query("traceability_audit", "records candidates candidate_evidence", """SELECT r.id, CASE WHEN r.candidate_id IS NULL THEN 'no_candidate' WHEN c.candidate_id IS NULL THEN 'candidate_missing' WHEN r.evidence_id IS NULL THEN 'no_evidence' WHEN ce.evidence_id IS NULL THEN 'evidence_not_linked' ELSE 'ok' END reason
  FROM records r LEFT JOIN candidates c ON c.candidate_id = r.candidate_id LEFT JOIN candidate_evidence ce ON ce.candidate_id = r.candidate_id AND ce.evidence_id = r.evidence_id""")
def _(r, c, ce):
    rows = r.select("id", "candidate_id", "evidence_id").join(c.select("candidate_id", F.lit(1).alias("has_c")), "candidate_id", "left").join(ce.select("candidate_id", "evidence_id", F.lit(1).alias("has_e")), ["candidate_id", "evidence_id"], "left")
    reason = F.when(F.col("candidate_id").isNull(), "no_candidate").when(F.col("has_c").isNull(), "candidate_missing").when(F.col("evidence_id").isNull(), "no_evidence").when(F.col("has_e").isNull(), "evidence_not_linked").otherwise("ok")
    return rows.select("id", reason.alias("reason"))


@query("evidence_integrity", "candidates candidate_evidence evidence", """SELECT c.candidate_id, count(ce.evidence_id) links, count(CASE WHEN ce.evidence_id IS NOT NULL AND e.evidence_id IS NULL THEN 1 END) missing, coalesce(string_agg(CASE WHEN e.evidence_id IS NULL THEN ce.evidence_id END, ',' ORDER BY ce.evidence_id), '') missing_ids
  FROM candidates c LEFT JOIN candidate_evidence ce ON ce.candidate_id = c.candidate_id LEFT JOIN (SELECT * FROM evidence WHERE content_hash <> 'stale') e ON e.evidence_id = ce.evidence_id GROUP BY c.candidate_id""")
def _(c, ce, e):
    known = e.where("content_hash <> 'stale'").select("evidence_id", F.lit(1).alias("known"))
    rows = c.select("candidate_id").join(ce, "candidate_id", "left").join(known, "evidence_id", "left")
    gone = F.when(F.col("evidence_id").isNotNull() & F.col("known").isNull(), F.col("evidence_id"))
    return rows.groupBy("candidate_id").agg(F.count("evidence_id").alias("links"), F.count(gone).alias("missing"), F.array_join(F.sort_array(F.collect_set(gone)), ",").alias("missing_ids"))


@query("fk_violations", "evidence archive", "SELECT evidence_id, document_id FROM evidence e WHERE document_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM archive a WHERE a.document_id = e.document_id AND a.content_hash = e.content_hash)")
def _(e, a):
    return e.where("document_id is not null").join(a, ["document_id", "content_hash"], "left_anti").select("evidence_id", "document_id")


@query("browse_records", "records", f"SELECT * FROM (SELECT 'published' AS mode, id, entity_id, period_label FROM records WHERE {RULE} AND period_label = '1997' ORDER BY id LIMIT 200) a UNION ALL SELECT * FROM (SELECT 'all', id, entity_id, period_label FROM records WHERE period_label = '1997' AND value_type = 'forecast' ORDER BY id LIMIT 200) b")
def _(r):
    """A page of the published records of a year, one of all its forecasts, and of published forecasts, of which there are none."""
    modes = {"published": t.browse(r, year="1997", published_only=True), "all": t.browse(r, year="1997", value_type="forecast"), "none": t.browse(r, year="1997", value_type="forecast", published_only=True)}
    pages = [df.orderBy("id").limit(200).select(F.lit(mode).alias("mode"), "id", "entity_id", "period_label") for mode, df in modes.items()]
    return pages[0].union(pages[1]).union(pages[2])


@query("recent_records", "records stations", "SELECT r.id, s.canonical_name FROM records r LEFT JOIN stations s ON s.entity_id = r.entity_id ORDER BY r.updated_at DESC, r.id DESC LIMIT 4")
def _(r, s):
    return r.orderBy(F.desc("updated_at"), F.desc("id")).limit(4).join(s.select("entity_id", "canonical_name"), "entity_id", "left").select("id", "canonical_name")


@query("record_detail", "records stations sources evidence archive", """SELECT r.id, s.canonical_name, o.title, e.page_number, d.original_url, d.content_kind FROM records r LEFT JOIN stations s ON s.entity_id = r.entity_id LEFT JOIN (SELECT source_id, min(title) title FROM sources GROUP BY source_id) o ON o.source_id = r.source_id
  LEFT JOIN evidence e ON e.evidence_id = r.evidence_id LEFT JOIN archive d ON d.document_id = e.document_id""")
def _(r, s, o, e, d):
    titles = o.groupBy("source_id").agg(F.min("title").alias("title"))
    rows = r.join(s.select("entity_id", "canonical_name"), "entity_id", "left").join(titles, "source_id", "left")
    rows = rows.join(e.select("evidence_id", "document_id", "page_number"), "evidence_id", "left").join(d.select("document_id", "original_url", "content_kind"), "document_id", "left")
    return rows.select("id", "canonical_name", "title", "page_number", "original_url", "content_kind")


@query("station_generation", "records sources", "SELECT r.entity_id, r.id, period_label, title FROM records r LEFT JOIN (SELECT source_id, min(title) title FROM sources GROUP BY source_id) o ON o.source_id = r.source_id")
def _(r, o):
    title = o.groupBy("source_id").agg(F.min("title").alias("title"))
    return r.join(title, "source_id", "left").select("entity_id", "id", "period_label", "title")


@query("station_detail", "stations records", "SELECT s.entity_id, count(r.id) records, count(DISTINCT period_label) n_years, max(period_label) latest, coalesce(string_agg(DISTINCT period_label, ',' ORDER BY period_label), '') labels FROM stations s LEFT JOIN records r ON r.entity_id = s.entity_id GROUP BY s.entity_id")
def _(s, r):
    years = F.sort_array(F.collect_set("period_label"))
    return s.select("entity_id").join(r.select("entity_id", "id", "period_label"), "entity_id", "left").groupBy("entity_id").agg(F.count("id").alias("records"), F.size(years).cast("long").alias("n_years"), F.max("period_label").alias("latest"), F.array_join(years, ",").alias("labels"))

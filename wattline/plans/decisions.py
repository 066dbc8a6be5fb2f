"""Queries on validation, review, promotion, decisions and imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.operators import decisions as de, extract as ex
from wattline.plans.registry import query
from wattline.sources.files import written

AS_OF = "2024-01-31 00:00:00"
CASES = "candidates stations tasks records"

#: The rules of validation in their order, as code:severity:field.
ISSUES = """[CASE WHEN normalized_unit IS NULL OR normalized_unit <> 'gwh' THEN 'UNIT_UNCLEAR:high:normalized_unit' END, CASE WHEN flags LIKE '%UNIT_UNCLEAR%' THEN 'UNIT_UNCLEAR:high:unit_raw' END,
  CASE WHEN flags LIKE '%UNIT_NOT_ENERGY%' OR flags LIKE '%CAPACITY_SUSPECT%' THEN 'CAPACITY_GENERATION_CONFLICT:high:unit_raw' END, CASE WHEN generation_gwh < 0 THEN 'VALUE_OUT_OF_RANGE:high:generation_gwh' END,
  CASE WHEN metric IS NULL OR metric = 'unknown' THEN 'METRIC_UNCLEAR:high:metric' WHEN metric <> 'gross_generation' THEN 'METRIC_MISMATCH:high:metric' END,
  CASE WHEN value_type = 'forecast' THEN 'ACTUAL_FORECAST_MIXED:high:value_type' WHEN value_type IS NULL THEN 'ACTUAL_FORECAST_MIXED:medium:value_type' END,
  CASE WHEN measurement_scope IN ('region', 'complex', 'group') THEN 'ENTITY_AMBIGUOUS:high:measurement_scope' END, CASE WHEN target_period <> period_label THEN 'YEAR_MISMATCH:high:period_label' END,
  CASE WHEN task_period_type = 'calendar_year' AND period_type = 'fiscal_year' THEN 'YEAR_MISMATCH:medium:period_type' END, CASE WHEN task_period_type = 'fiscal_year' AND period_type <> 'fiscal_year' THEN 'PERIOD_AMBIGUOUS:high:period_type' END,
  CASE WHEN flags LIKE '%PERIOD_UNCLEAR%' THEN 'PERIOD_AMBIGUOUS:medium:period_type' END, CASE WHEN capacity_mw > 0 AND generation_gwh > capacity_mw * 8760 / 1000 * 1.15e0 THEN 'CAPACITY_GENERATION_CONFLICT:high:generation_gwh' END,
  CASE WHEN there THEN 'DUPLICATE_RECORD:medium:' END, CASE WHEN confidence < 0.55e0 THEN 'LOW_CONFIDENCE:medium:confidence' END]"""
VALID = f""", checked AS (SELECT *, list_filter({ISSUES}, lambda x: x IS NOT NULL) issues FROM (SELECT c.*, s.capacity_mw, s.priority_tier, t.target_period, t.task_period_type,
  EXISTS (SELECT 1 FROM records r WHERE r.publication_status = 'publishable' AND r.entity_id = c.entity_id AND r.period_label = c.period_label AND r.value_type = c.value_type AND r.measurement_scope = c.measurement_scope) there
  FROM candidates c LEFT JOIN stations s ON s.entity_id = c.entity_id LEFT JOIN tasks t ON t.task_id = c.task_id) x),
  valid AS (SELECT *, len(list_filter(issues, lambda x: x NOT LIKE 'LOW_CONFIDENCE%')) = 0 passed, len(list_filter(issues, lambda x: x LIKE '%:high:%')) > 0 blocking FROM checked) """


def flagged(x):
    """flags as an array."""
    return x.withColumn("flags", F.filter(F.split("flags", ","), lambda f: f != ""))


def valid(x, s, t, r, judge=ex.validate_candidates):
    return judge(flagged(x), s, t, r.where("publication_status = 'publishable'"))


@query("validate_candidates", CASES, VALID + "SELECT candidate_id, array_to_string(issues, ',') issues, passed, blocking, CASE WHEN blocking THEN 'high' WHEN len(issues) > 0 THEN 'medium' END severity FROM valid")
def _(x, s, t, r):
    text = F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["code"], i["severity"], i["field"])), ",")
    return valid(x, s, t, r).select("candidate_id", text.alias("issues"), "passed", "blocking", "severity")


@query("score_record", CASES + " candidate_evidence evidence", VALID + """SELECT candidate_id, round(greatest(0.0e0, least(1.0e0, (CASE WHEN passed THEN 0.8e0 ELSE 0.6e0 - 0.3e0 * len(list_filter(issues, lambda x: x LIKE '%:high:%')) - 0.1e0 * len(list_filter(issues, lambda x: x LIKE '%:medium:%')) END
  + CASE WHEN pages IS NOT NULL THEN 0.1e0 ELSE 0.0e0 END + CASE WHEN pages > 0 THEN 0.05e0 ELSE 0.0e0 END + coalesce(confidence, 0.5e0)) / 2)), 6) score FROM valid v
  LEFT JOIN (SELECT ce.candidate_id cid, max(page_number) pages FROM candidate_evidence ce JOIN evidence e ON e.evidence_id = ce.evidence_id GROUP BY 1) p ON p.cid = v.candidate_id""")
def _(x, s, t, r, ce, e):
    found = ce.join(e.select("evidence_id", "page_number"), "evidence_id").groupBy("candidate_id").agg(F.lit(True).alias("has_evidence"), (F.max("page_number") > 0).alias("has_page"))
    rated = valid(x, s, t, r, ex.rule_scores).select("candidate_id", "confidence", "rule_score")  # a number is shuffled, not the issues
    return rated.join(found, "candidate_id", "left").select("candidate_id", ex.record_confidence(F.col("rule_score")).alias("score"))


@query("needs_review", CASES, VALID + """SELECT candidate_id, flags LIKE '%OCR_DERIVED%' OR coalesce(priority_tier, '') = 'A' OR len(list_filter(issues, lambda x: x LIKE '%:high:%' OR (x NOT LIKE 'METRIC%' AND x NOT LIKE 'VALUE%'))) > 0 review FROM valid""")
def _(x, s, t, r):
    rows = valid(x, s, t, r).join(s.select("entity_id", "priority_tier"), "entity_id", "left")
    return rows.select("candidate_id", ex.needs_review().alias("review"))


GATES = """[CASE WHEN period_type <> 'calendar_year' OR NOT regexp_full_match(period_label, '(?:19|20)[0-9]{2}') OR flags LIKE '%PERIOD_UNCLEAR%' THEN 'period' END, CASE WHEN metric <> 'gross_generation' THEN 'metric' END, CASE WHEN measurement_scope <> 'plant' THEN 'scope' END,
  CASE WHEN value_type IS NULL OR value_type <> 'actual' THEN 'value_type' END, CASE WHEN generation_gwh IS NULL OR unit_raw <> 'GWh' THEN 'unit' END, CASE WHEN first_evidence IS NULL THEN 'evidence' END, CASE WHEN review_status <> 'approved' THEN 'review' END]"""
GATED = f"list_filter({GATES}, lambda x: x IS NOT NULL)"


@query("promotion_gates", "candidates candidate_evidence evidence whole_chains", f"SELECT c.candidate_id, array_to_string({GATED}, ',') failed FROM candidates c LEFT JOIN whole_chains w ON w.candidate_id = c.candidate_id")
def _(x, ce, e, _w):
    linked = ce.join(e.select("evidence_id"), "evidence_id", "left_semi").select("candidate_id").distinct().withColumn("has_evidence", F.lit(True))
    return flagged(x).join(linked, "candidate_id", "left").select("candidate_id", F.array_join(ex.promotion_gates(), ",").alias("failed"))


PROMO = CASES + " candidate_evidence evidence whole_chains"
REFUSED = f""", refusals AS (SELECT v.*, w.first_evidence, w.whole, len({GATED}) + len(list_filter([value_type, measurement_scope, cast(generation_gwh AS string)], lambda x: x IS NULL)) + CASE WHEN blocking THEN 1 ELSE 0 END refused FROM valid v LEFT JOIN whole_chains w ON w.candidate_id = v.candidate_id) """


def ready(x, s, t, r, ce, e):
    """Candidates, validated without regard to what is published, and why they may not be promoted."""
    return de.promotable(ex.validate_candidates(flagged(x), s, t), ce, e)


FRESH = VALID.replace("EXISTS (SELECT 1 FROM records r WHERE r.publication_status = 'publishable' AND r.entity_id = c.entity_id AND r.period_label = c.period_label AND r.value_type = c.value_type AND r.measurement_scope = c.measurement_scope) there", "false there")


@query("promote", PROMO, FRESH + REFUSED + f""", good AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, period_type, period_label, value_type, measurement_scope ORDER BY extracted_at DESC, candidate_id DESC) n FROM refusals WHERE refused = 0) g WHERE n = 1),
  facts_now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, period_type, period_label, value_type, measurement_scope ORDER BY created_at DESC, id DESC) n FROM records) o WHERE n = 1)
  SELECT coalesce(o.entity_id, g.entity_id) entity_id, coalesce(o.period_label, g.period_label) period_label, coalesce(o.period_type, g.period_type) period_type, coalesce(o.value_type, g.value_type) value_type, round(CASE WHEN g.candidate_id IS NOT NULL THEN g.generation_gwh ELSE o.generation_gwh END, 4) gwh,
  coalesce(g.candidate_id, o.candidate_id) candidate_id, CASE WHEN g.candidate_id IS NOT NULL THEN g.first_evidence ELSE o.evidence_id END evidence_id, CASE WHEN g.candidate_id IS NULL THEN o.validation_status WHEN g.passed THEN 'passed' ELSE 'passed_with_issues' END validation_status,
  CASE WHEN g.candidate_id IS NULL THEN o.publication_status ELSE 'publishable' END publication_status, coalesce(o.created_at, TIMESTAMP '{AS_OF}') created_at, CASE WHEN g.candidate_id IS NULL THEN o.updated_at ELSE TIMESTAMP '{AS_OF}' END updated_at,
  CASE WHEN g.candidate_id IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'created' ELSE 'updated' END fate FROM facts_now o FULL JOIN good g ON g.entity_id = o.entity_id AND g.period_type = o.period_type AND g.period_label = o.period_label AND g.value_type = o.value_type AND g.measurement_scope = o.measurement_scope""")
def _(x, s, t, r, ce, e, _w):
    out = de.promote(r, ready(x, s, t, r, ce, e), F.lit(AS_OF).cast("timestamp"))
    return out.select("entity_id", "period_label", "period_type", "value_type", F.round("generation_gwh", 4).alias("gwh"), "candidate_id", "evidence_id", "validation_status", "publication_status", "created_at", "updated_at", "fate")


DECIDE = "decisions reviews candidates stations tasks records candidate_evidence evidence archive whole_chains"
#: The hash under which an item was queued: none for every tenth, another one for every tenth.
LAST = "substr(review_id, length(review_id), 1)"
JUDGED = f""", verdicts AS (SELECT *, CASE WHEN NOT known THEN 'unknown_decision' WHEN item_status IS NULL THEN 'no_item' WHEN item_status <> 'open' OR turn > 1 THEN 'not_open' WHEN decision = 'approve' AND {LAST} = '7' THEN 'changed'
  WHEN decision = 'approve' AND ({LAST} = '3' OR coalesce(whole, 0) = 0) THEN 'no_hash' WHEN decision = 'approve' AND refused > 0 THEN 'not_promotable' ELSE 'applied' END outcome FROM
  (SELECT d.*, decision IN ('approve', 'reject', 'request_more_evidence', 'cancel') known, row_number() OVER (PARTITION BY d.review_id, decision IN ('approve', 'reject', 'request_more_evidence', 'cancel') ORDER BY decided_at, decision_id) turn,
    r.status item_status, r.candidate_id, r.entity_id, r.task_id, f.period_label, f.value_type, f.first_evidence, f.whole, f.refused FROM decisions d LEFT JOIN reviews r ON r.review_id = d.review_id
    LEFT JOIN (SELECT candidate_id cid, period_label, value_type, first_evidence, whole, len({GATED}) + len(list_filter([value_type, measurement_scope, cast(generation_gwh AS string)], lambda x: x IS NULL)) + CASE WHEN blocking THEN 1 ELSE 0 END refused FROM
      (SELECT v.* EXCLUDE (review_status), 'approved' review_status, w.first_evidence, w.whole FROM valid v LEFT JOIN whole_chains w ON w.candidate_id = v.candidate_id) q) f ON f.cid = r.candidate_id) j),
  items AS (SELECT r.* EXCLUDE (status), coalesce(n.status, r.status) status FROM reviews r LEFT JOIN (SELECT review_id, CASE WHEN outcome = 'changed' THEN 'invalidated' WHEN decision = 'cancel' THEN 'cancelled' ELSE decision END status FROM verdicts WHERE outcome IN ('applied', 'not_promotable', 'changed')) n ON n.review_id = r.review_id) """
DECIDED = FRESH + JUDGED


def _queued(r, hashes):
    """reviews with the hash under which they were queued."""
    last = F.substring("review_id", -1, 1)
    return r.join(hashes.select("candidate_id", "candidate_hash"), "candidate_id", "left").withColumn("approved_hash", F.when(last == "3", None).when(last == "7", "stale").otherwise(F.col("candidate_hash"))).drop("candidate_hash")


def _hashed(x, ce, e, a):
    """candidates and their hashes, both stored once: items and candidates need them."""
    x = written(x, "candidates")
    return x, written(de.approval_hashes(x, ce, e, a), "hashes")


def _applied(d, rv, x, s, t, r, ce, e, a):
    x, hashes = _hashed(x, ce, e, a)
    checked = ex.validate_candidates(flagged(x), s, t).withColumn("review_status", F.lit("approved"))  # as a decision would make them
    rows = de.refusals(checked.join(hashes, "candidate_id"))
    return de.apply_decisions(d, _queued(rv, hashes), x, rows, r, t, F.lit(AS_OF).cast("timestamp"))


@query("decision_outcomes", DECIDE, DECIDED + "SELECT decision_id, review_id, outcome FROM verdicts")
def _(d, rv, x, s, t, r, ce, e, a, _w):
    return _applied(d, rv, x, s, t, r, ce, e, a)["verdicts"].select("decision_id", "review_id", "outcome")


@query("apply_decisions", DECIDE, DECIDED + """SELECT t.task_id, CASE WHEN t.status IN ('success', 'cancelled') THEN t.status WHEN broken > 0 THEN 'failed' WHEN o.task_id IS NULL AND final IS NOT NULL THEN CASE WHEN final = 'approve' THEN 'success' ELSE 'failed' END ELSE t.status END status FROM tasks t
  LEFT JOIN (SELECT task_id, count(CASE WHEN outcome IN ('no_hash', 'changed', 'not_promotable') THEN 1 END) broken, last(CASE WHEN outcome = 'applied' AND decision IN ('approve', 'reject') THEN decision END ORDER BY decided_at, decision_id) FILTER (WHERE outcome = 'applied' AND decision IN ('approve', 'reject')) final FROM verdicts WHERE task_id IS NOT NULL GROUP BY task_id) v ON v.task_id = t.task_id
  LEFT JOIN (SELECT DISTINCT task_id FROM items WHERE status = 'open') o ON o.task_id = t.task_id""")
def _(d, rv, x, s, t, r, ce, e, a, _w):
    return _applied(d, rv, x, s, t, r, ce, e, a)["tasks"].select("task_id", "status")


@query("decided_reviews", DECIDE, DECIDED + "SELECT review_id, status FROM items")
def _(d, rv, x, s, t, r, ce, e, a, _w):
    return _applied(d, rv, x, s, t, r, ce, e, a)["reviews"].select("review_id", "status")


@query("decision_events", DECIDE, DECIDED + """SELECT 'evt_' || substr(sha1(review_id || '::' || decision), 1, 16) event_id, review_id, candidate_id, CASE decision WHEN 'cancel' THEN 'cancel' ELSE 'decide' END AS action, nullif(decision, 'cancel') decision, reviewer, CASE WHEN decision <> 'approve' THEN reason END reason
  FROM verdicts WHERE outcome = 'applied' AND decision <> 'request_more_evidence'""")
def _(d, rv, x, s, t, r, ce, e, a, _w):
    return _applied(d, rv, x, s, t, r, ce, e, a)["events"]


@query("decided_candidates", DECIDE, DECIDED + """SELECT c.candidate_id, coalesce(n.status, c.review_status) review_status FROM candidates c LEFT JOIN (SELECT candidate_id, CASE decision WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'pending' END status FROM verdicts WHERE outcome = 'applied' AND decision <> 'request_more_evidence') n ON n.candidate_id = c.candidate_id""")
def _(d, rv, x, s, t, r, ce, e, a, _w):
    return _applied(d, rv, x, s, t, r, ce, e, a)["candidates"].select("candidate_id", "review_status")


@query("decided_records", DECIDE, DECIDED + f""", steps AS (SELECT entity_id, period_label, coalesce(value_type, 'actual') value_type, list({{'d': decision, 'e': first_evidence}} ORDER BY decided_at, decision_id) ds FROM verdicts WHERE outcome = 'applied' AND decision <> 'request_more_evidence' GROUP BY 1, 2, 3),
  folded AS (SELECT r.*, list_reduce(list_prepend({{'p': publication_status, 'r': review_status, 'v': validation_status, 'e': evidence_id, 'd': ''}}, list_transform(ds, lambda x: {{'p': '', 'r': '', 'v': '', 'e': x.e, 'd': x.d}})), lambda n, x: {{
    'p': CASE WHEN x.d = 'reject' AND (n.p = 'draft' OR coalesce(n.r = 'open', false)) THEN 'withheld' ELSE n.p END, 'r': CASE WHEN x.d = 'approve' THEN 'approved' WHEN x.d = 'cancel' THEN NULL WHEN n.p = 'draft' OR coalesce(n.r = 'open', false) THEN 'rejected' ELSE n.r END,
    'v': CASE WHEN x.d = 'approve' THEN 'validated' ELSE n.v END, 'e': CASE WHEN x.d = 'approve' THEN x.e ELSE n.e END, 'd': CASE WHEN x.d <> 'reject' OR n.p = 'draft' OR coalesce(n.r = 'open', false) THEN 'touched' ELSE n.d END}}) now FROM records r JOIN steps s ON s.entity_id = r.entity_id AND s.period_label = r.period_label AND s.value_type = r.value_type)
  SELECT id, now.p publication_status, now.r review_status, now.v validation_status, now.e evidence_id, CASE WHEN now.d = 'touched' THEN TIMESTAMP '{AS_OF}' ELSE updated_at END updated_at FROM folded
  UNION ALL SELECT id, publication_status, review_status, validation_status, evidence_id, updated_at FROM records r WHERE NOT EXISTS (SELECT 1 FROM steps s WHERE s.entity_id = r.entity_id AND s.period_label = r.period_label AND s.value_type = r.value_type)""")
def _(d, rv, x, s, t, r, ce, e, a, _w):
    return _applied(d, rv, x, s, t, r, ce, e, a)["records"].select("id", "publication_status", "review_status", "validation_status", "evidence_id", "updated_at")


APPROVED = "reviews candidates candidate_evidence evidence archive whole_chains"


def _facts(x, hashes):
    """candidates with the fact that they are about and their hash."""
    return x.join(hashes, "candidate_id").select("candidate_id", "entity_id", F.lit("generation").alias("fact_type"), F.concat_ws("|", "entity_id", "period_label").alias("fact_key"), "candidate_hash")


@query("approval_reuse", APPROVED, f"""SELECT c.candidate_id, r.review_id, r.candidate_id = c.candidate_id AND {LAST.replace('review_id', 'r.review_id')} NOT IN ('3', '7') AND coalesce(whole, 0) = 1 reusable FROM candidates c JOIN
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, fact_type, fact_key ORDER BY created_at DESC, review_id DESC) n FROM reviews WHERE status = 'approved') z WHERE n = 1 AND fact_type = 'generation') r
  ON r.entity_id = c.entity_id AND r.fact_key = c.entity_id || '|' || c.period_label LEFT JOIN whole_chains w ON w.candidate_id = c.candidate_id""")
def _(rv, x, ce, e, a, _w):
    x, hashes = _hashed(x, ce, e, a)
    return de.approval_reuse(_queued(rv, hashes), _facts(x, hashes))


@query("approval_invalidate", APPROVED, f"""SELECT DISTINCT r.review_id FROM reviews r LEFT JOIN whole_chains o ON o.candidate_id = r.candidate_id JOIN candidates c ON r.entity_id = c.entity_id AND r.fact_type = 'generation' AND r.fact_key = c.entity_id || '|' || c.period_label
  JOIN whole_chains w ON w.candidate_id = c.candidate_id AND w.whole = 1 WHERE r.status = 'approved' AND {LAST.replace('review_id', 'r.review_id')} <> '3' AND ({LAST.replace('review_id', 'r.review_id')} = '7' OR (coalesce(o.whole, 0) = 1 AND r.candidate_id <> c.candidate_id))""")
def _(rv, x, ce, e, a, _w):
    x, hashes = _hashed(x, ce, e, a)
    return de.approval_invalidate(_queued(rv, hashes), _facts(x, hashes))


IMPORT_ERROR = """CASE WHEN trim(entity_id) = '' OR trim(period_label) = '' OR trim(generation_gwh) = '' THEN 'empty' WHEN NOT regexp_full_match(trim(period_label), '[0-9]{4}') THEN 'period_label' WHEN trim(period_type) <> 'calendar_year' THEN 'period_type' WHEN lower(trim(value_type)) <> 'actual' THEN 'value_type'
  WHEN lower(trim(measurement_scope)) <> 'plant' THEN 'measurement_scope' WHEN lower(trim(metric)) <> 'gross_generation' THEN 'metric' WHEN coalesce(try_cast(trim(generation_gwh) AS double), -1) < 0 THEN 'generation_gwh' WHEN s_id IS NULL THEN 'unknown_entity'
  WHEN lower(trim(unit_raw)) NOT IN ('gwh', 'mwh', 'twh', 'kwh', '亿千瓦时', '万千瓦时', '千瓦时') THEN 'unit_raw' WHEN trim(confidence) <> '' AND NOT coalesce(try_cast(trim(confidence) AS double) BETWEEN 0 AND 1, false) THEN 'confidence' END"""
IMPORTED = f""", imported AS (SELECT *, CASE WHEN error IS NULL THEN 'cand_' || substr(sha256('doc_import|' || cast(row AS string) || '|' || trim(entity_id) || '|' || trim(period_label) || '|' || trim(generation_gwh) || '|' || trim(unit_raw)), 1, 24) END candidate_id
  FROM (SELECT i.*, s.s_name, {IMPORT_ERROR} error FROM import_rows i LEFT JOIN (SELECT entity_id s_id, canonical_name s_name FROM stations) s ON s.s_id = trim(i.entity_id)) z) """


@query("import_candidates", "import_rows stations", IMPORTED + """SELECT row, error, candidate_id, 'evi_' || substr(sha256('doc_import:' || candidate_id), 1, 24) evidence_id, 'manual_review::' || substr(sha256(candidate_id), 1, 16) task_id,
  CASE WHEN candidate_id IS NOT NULL THEN 'CSV row ' || cast(row AS string) || ': ' || trim(entity_id) || ', ' || trim(period_label) || ', ' || trim(generation_gwh) || ' ' || trim(unit_raw) END snippet, CASE WHEN candidate_id IS NOT NULL THEN 'CSV_IMPORT_REVIEW' || CASE WHEN trim(canonical_name) <> '' AND trim(canonical_name) <> s_name THEN '; ENTITY_AMBIGUOUS' ELSE '' END END review_reason FROM imported""")
def _(rows, s):
    return de.import_candidates(rows, s, F.lit("doc_import")).select("row", "error", "candidate_id", "evidence_id", "task_id", "snippet", "review_reason")


@query("import_counts", "import_rows stations", IMPORTED + "SELECT count(*) read, count(CASE WHEN error IS NULL AND row % 10 <> 0 THEN 1 END) imported, count(CASE WHEN error IS NULL AND row % 10 = 0 THEN 1 END) existing, count(error) skipped FROM imported")
def _(rows, s):
    """A tenth of the rows was imported before."""
    done = de.import_candidates(rows, s, F.lit("doc_import"))
    return de.import_counts(done, done.where("row % 10 = 0 and error is null"))

"""Queries on sources, text, identifiers, extraction, validation, state changes and streams."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from wattline.functions import text as tx
from wattline.operators import discovery as di, extract as ex, facts as fa, frames as fr, layout as la, lookup as lo, registry as rg, trust as t
from wattline.operators.station_rows import extract_rows
from wattline.plans.registry import query
from wattline.plans.trust import RULE
from wattline.sources.files import csv_rows, read_seed, scratch
from wattline.streaming import jobs

URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
#: Query keys that only track.
TRACK = "'fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'referrer', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term'"


def g(i: int) -> str:
    return f"regexp_extract(trim(url), '{URL}', {i})"


PARTS = f"list_filter(string_split(substr({g(4)}, 2), '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN ({TRACK}))"
CANON = f"""(lower({g(1)}) || '://' || lower({g(2)}) || CASE WHEN regexp_replace({g(3)}, '/+', '/', 'g') IN ('', '/') THEN '/' ELSE regexp_replace(regexp_replace({g(3)}, '/+', '/', 'g'), '/$', '') END
  || CASE WHEN len({PARTS}) > 0 THEN '?' || array_to_string({PARTS}, '&') ELSE '' END)"""


@query("canonical_url", "urls candidate_urls", f"SELECT doc_id id, canonical FROM urls UNION ALL SELECT page_id, {CANON} FROM candidate_urls")
def _(cases, u):
    both = cases.select(F.col("doc_id").alias("id"), "url").union(u.select("page_id", "url"))
    return both.select("id", tx.canonical_url(F.col("url")).alias("canonical"))


@query("publisher_domain", "urls", r"SELECT doc_id, regexp_extract(canonical, '^https://(?:www\.)?([^/?]*)', 1) AS domain FROM urls")
def _(u):
    return u.select("doc_id", tx.publisher_domain(F.col("url")).alias("domain"))


@query("doc_type", "sources", "SELECT url, CASE WHEN lower(url) LIKE '%.pdf' THEN 'pdf' WHEN lower(url) LIKE '%.csv' THEN 'csv' ELSE 'html' END kind FROM sources")
def _(s):
    return s.select("url", tx.doc_type(F.col("url")).alias("kind"))


@query("path_template", "sources", rf"SELECT url, regexp_replace({g(3)}, '(^|[^0-9])((?:19|20)[0-9][0-9])([^0-9]|$)', '\1{{year}}\3', 'g') template FROM sources")
def _(s):
    return s.select("url", tx.path_template(F.col("url")).alias("template"))


@query("link_class", "sources", r"""SELECT url, CASE WHEN regexp_matches(url, '\.gov/') THEN 'authority' WHEN lower(title) LIKE '%7' THEN 'official' ELSE 'reference' END kind,
  CASE WHEN regexp_matches(url, '\.gov/') THEN 0.95e0 WHEN lower(title) LIKE '%7' THEN 0.92e0 WHEN url LIKE '%.org/%' THEN 0.72e0 ELSE 0.65e0 END score FROM sources""")
def _(s):
    """Every tenth source's title says that it is the operator's."""
    words = F.concat("title", F.when(F.col("title").endswith("7"), " Operator site").otherwise(" news"))
    return s.select("url", F.inline(F.array(tx.link_class(F.col("url"), words))))


@query("combined_score", "candidate_urls", "SELECT page_id, round(least(1.0e0, 0.65e0 * score + 0.35e0 * coalesce(CASE WHEN page_id % 3 <> 0 THEN score END, 0)), 4) score FROM candidate_urls")
def _(u):
    relevance = F.coalesce(F.when(F.col("page_id") % 3 != 0, F.col("score")), F.lit(0.0))
    return u.select("page_id", F.round(F.least(F.lit(1.0), 0.65 * F.col("score") + 0.35 * relevance), 4).alias("score"))


def decoded(x: str) -> str:
    """SQL for the character references that pages use; the ampersand's last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "\'\'"), ("&#x27;", "\'\'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


BARE = "html"
for _tag in ("script", "style", "head", "noscript", "table"):
    BARE = f"regexp_replace({BARE}, '(?s)<{_tag}[ >].*?</{_tag}>', ' ', 'g')"
BARE = f"regexp_replace(regexp_replace({BARE}, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', ' ', 'g')"


def text_decoded(x: str) -> str:
    """SQL for the character references in text, where old names and numbers need no semicolon: a title may be cut inside one."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("copy", "©"), ("middot", "·")):
        x = f"regexp_replace({x}, '&{name};?', '{char}', 'g')"
    for number, digit in (("39", "0-9"), ("[xX]27", "0-9A-Fa-f")):
        x = rf"regexp_replace({x}, '&#0*{number}(?:;|([^;{digit}])|$)', '''\1', 'g')"
    return f"regexp_replace(replace(replace({x}, '&mdash;', '—'), '&hellip;', '…'), '&amp;?', '&', 'g')"


@query("html_text", "pages", f"""SELECT page_id, trim(regexp_replace({text_decoded("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '[[:space:]]+', ' ', 'g')) title, trim(regexp_replace({text_decoded(BARE)}, '[[:space:]]+', ' ', 'g')) AS text, true ok FROM pages""")
def _(p):
    return ex.parse_pages(p.select("page_id", "html")).select("page_id", "parsed.title", "parsed.text", "parsed.ok")


@query("html_links", "pages", f"""SELECT page_id, k AS nth, {decoded("hrefs[k + 1]")} href FROM (SELECT page_id, hrefs, unnest(range(len(hrefs))) k FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1) hrefs FROM pages) x) y""")
def _(p):
    return ex.parse_pages(p.select("page_id", "html")).select("page_id", F.posexplode("parsed.links").alias("nth", "href"))


@query("html_tables", "fact_pages", r"""SELECT doc_id, headers, row_text FROM (SELECT doc_id, doc_id % 6 AS k, 'Dam ' || n AS name, v, y FROM order_values) p JOIN
  (SELECT * FROM (VALUES (0, 'Station|Y Generation (GWh)|Y Generation change %', 'N Hydropower Station|V|3'), (0, 'Station|Y Generation (GWh)|Y Generation change %', 'Other dam|55|1'), (1, 'Plant|Output MWh|Output 第一季度 MWh', 'N|V|7'),
   (2, '', 'In Y annual generation|V GWh'), (3, 'Plant|Season 季度', 'N|V'), (4, 'N|Y generation GWh', 'N|V')) t(tk, h, r)) t ON tk = k, LATERAL (SELECT replace(replace(h, 'Y', y), 'N', name) headers, replace(replace(replace(r, 'Y', y), 'V', v), 'N', name) row_text) z""")
def _(s):
    tables = ex.parse_pages(s.select("doc_id", "html")).select("doc_id", F.explode("parsed.tables").alias("t"))
    return tables.select("doc_id", F.array_join("t.headers", "|").alias("headers"), F.explode("t.rows").alias("row")).select("doc_id", "headers", F.array_join("row", "|").alias("row_text"))


@query("json_doc", "events", "SELECT event_id, json_valid(props) ok, cast(json_extract(props, '$.k') AS bigint) k FROM events")
def _(e):
    parsed = F.try_parse_json("props")
    return e.select("event_id", parsed.isNotNull().alias("ok"), F.try_variant_get(parsed, "$.k", "bigint").alias("k"))


@query("csv_doc_table", "order_values", """SELECT doc_id, nth, name, amount, note FROM (SELECT doc_id, 1 nth, 'Dam, ' || n AS name, v AS amount, 'a "b" c' note FROM order_values UNION ALL SELECT doc_id, 2, n, z, NULL FROM order_values UNION ALL SELECT doc_id, 3, 'line' || chr(10) || n || chr(10) || chr(10) || 'end "', y, 'x,' || chr(10) || '"' FROM order_values WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 3 END, NULL, v, NULL FROM order_values) x""")
def _(s):
    """Quoted commas, quotes and line ends, a byte order mark, blank lines and a short row."""
    more = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('"line\n'), "n", F.lit('\n\nend """,'), "y", F.lit(',"x,\n"""\r\n'))).otherwise("")
    body = F.concat(F.lit("\ufeffname,amount,note\r\n\""), F.lit("Dam, "), "n", F.lit('",'), "v", F.lit(',"a ""b"" c"\n\n  \n'), "n", F.lit(","), "z", F.lit("\n"), more, F.lit('"",'), "v", F.lit(',""'))
    return csv_rows(s.select("doc_id", body.alias("body")), "doc_id", "body", "name string, amount string, note string")


FACT_COLUMNS = "period_label, value_raw, unit_raw, round(gwh, 6) gwh, metric, value_type, measurement_scope, period_type, flags"


def _facts(rows):
    return rows.withColumns({"gwh": F.round("generation_gwh", 6), "flags": F.array_join("flags", ",")}).select("doc_id", F.col("at").alias("nth"), "period_label", "value_raw", "unit_raw", "gwh", "metric", "value_type", "measurement_scope", "period_type", "flags")


@query("extract_text", "fact_texts facts", f"SELECT doc_id, nth, {FACT_COLUMNS} FROM facts")
def _(texts, _expected):
    return _facts(fa.extract_text(texts, "doc_id", "text"))


@query("find_years", "year_lists", "SELECT doc_id, listed FROM year_lists")
def _(s):
    return s.select("doc_id", F.array_join(tx.find_years(F.col("text")), ",").alias("listed"))


@query("unit_norm", "units", "SELECT doc_id, kind, factor FROM units")
def _(s):
    return s.select("doc_id", tx.unit_kind(F.col("unit")).alias("kind"), tx.unit_factor(F.col("unit")).alias("factor"))


@query("parse_number", "numbers", "SELECT doc_id, number FROM numbers")
def _(s):
    return s.select("doc_id", tx.parse_number(F.col("raw")).alias("number"))


@query("text_clues", "clues", "SELECT period, metric, value_type, scope, full_year, count(*) n FROM clues GROUP BY period, metric, value_type, scope, full_year")
def _(s):
    """How often each combination of clues occurs."""
    x = F.col("text")
    found = s.select(tx.period_type(x).alias("period"), tx.metric_clue(x).alias("metric"), tx.value_type_clue(x).alias("value_type"), tx.scope_clue(x).alias("scope"), tx.full_year_clue(x).alias("full_year"))
    return found.groupBy(*found.columns).agg(F.count("*").alias("n"))


@query("turbines", "part", "SELECT p_partkey, cast(p_size + p_size % 5 AS int) n FROM part")
def _(p):
    s = F.concat(F.col("p_size").cast("string"), F.lit(" x 700 MW; "), (F.col("p_size") % 5).cast("string"), F.lit(" X 50 MW"))
    return p.select("p_partkey", tx.turbines(s).alias("n"))


@query("capacity_ceiling", "stations", "SELECT entity_id, round(capacity_mw * 8760 / 1000 * 1.15e0, 4) gwh FROM stations")
def _(s):
    return s.select("entity_id", F.round(tx.capacity_ceiling(F.col("capacity_mw")), 4).alias("gwh"))


@query("source_fresh", "sources", "SELECT url, last_success IS NOT NULL AND floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(last_success)) / 86400) <= 90 fresh, last_failure IS NOT NULL AND floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(last_failure)) / 86400) < 7 failing FROM sources")
def _(s):
    days = lambda n: F.floor((F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_timestamp(n)) / 86400)
    return s.select("url", F.coalesce(days("last_success") <= 90, F.lit(False)).alias("fresh"), F.coalesce(days("last_failure") < 7, F.lit(False)).alias("failing"))


@query("ids", "records candidates", """SELECT r.id, r.entity_id || '::generation::' || r.period_label || CASE WHEN r.period_type <> 'calendar_year' THEN '::' || r.period_type ELSE '' END id_task, 'src_' || substr(sha1(r.source_id || '::' || r.candidate_id), 1, 16) id_source,
  'ev_' || substr(sha1('generation::' || r.period_label || '::' || coalesce(r.evidence_id, '')), 1, 16) id_evidence, 'lead_' || substr(sha256(r.entity_id || chr(31) || coalesce(r.evidence_id, '') || chr(31) || r.source_id), 1, 20) id_lead FROM records r""")
def _(r, _c):
    k = F.col
    return r.select("id", tx.task_id(k("entity_id"), F.lit("generation"), k("period_label"), k("period_type")).alias("id_task"), tx.short_id("src_", k("source_id"), k("candidate_id")).alias("id_source"), tx.short_id("ev_", F.lit("generation"), k("period_label"), k("evidence_id")).alias("id_evidence"), tx.stable_id("lead_", k("entity_id"), k("evidence_id"), k("source_id")).alias("id_lead"))


@query("content_hash", "pages", "SELECT page_id, sha256(html) hash, octet_length(encode(html)) file_size FROM pages")
def _(p):
    return p.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("hash"), F.octet_length("html").cast("long").alias("file_size"))


PROJECT_ISSUES = """[CASE WHEN status IS NULL OR status = '' THEN 'MISSING_REQUIRED_FIELD:medium' WHEN status NOT IN ('newly_commissioned', 'under_construction', 'approved', 'announced') THEN 'PROJECT_STATUS_CONFLICT:medium' END, CASE WHEN capacity_mw < 0 THEN 'VALUE_OUT_OF_RANGE:high' END,
  CASE WHEN status = 'newly_commissioned' AND commissioning_year IS NULL THEN 'PROJECT_DATE_CONFLICT:medium' END, CASE WHEN status = 'newly_commissioned' AND commissioning_year > 2010 THEN 'PROJECT_DATE_CONFLICT:high' END]"""
VARIED = """(SELECT entity_id, capacity_mw, CASE WHEN length(canonical_name) % 2 = 1 THEN '' WHEN capacity_mw < 1000 THEN 'mothballed' ELSE status END status, CASE WHEN capacity_mw > 8000 THEN NULL ELSE commissioning_year + 40 END commissioning_year FROM projects)"""


@query("validate_projects", "projects", f"SELECT entity_id, array_to_string(list_filter({PROJECT_ISSUES}, lambda x: x IS NOT NULL), ',') issues FROM {VARIED} p")
def _(p):
    """As of 2010; some statuses are made missing or unknown, some years missing or late."""
    status = F.when(F.length("canonical_name") % 2 == 1, "").when(F.col("capacity_mw") < 1000, "mothballed").otherwise(F.col("status"))
    year = F.when(F.col("capacity_mw") <= 8000, F.col("commissioning_year") + 40)
    rows = ex.validate_projects(p.withColumns({"status": status, "commissioning_year": year}), 2010)
    return rows.select("entity_id", F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["code"], i["severity"])), ",").alias("issues"))


@query("review_enqueue", "reviews", "SELECT review_id, CASE WHEN n = 1 THEN fact_key ELSE fact_key || '#' || candidate_id END fact_key, CASE WHEN n > 1 THEN 'CONFLICT_CANDIDATE' ELSE reason END reason FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, fact_type, fact_key ORDER BY created_at, review_id) n FROM reviews) x")
def _(r):
    n = F.row_number().over(Window.partitionBy("entity_id", "fact_type", "fact_key").orderBy("created_at", "review_id"))
    rows = r.withColumn("n", n)
    return rows.select("review_id", F.when(F.col("n") == 1, F.col("fact_key")).otherwise(F.concat_ws("#", "fact_key", "candidate_id")).alias("fact_key"), F.when(F.col("n") > 1, "CONFLICT_CANDIDATE").otherwise(F.col("reason")).alias("reason"))


@query("generate_tasks", "stations projects", """SELECT entity_id || '::' || kind || '::' || period task_id, priority_tier, collection_priority FROM (SELECT * FROM stations ORDER BY priority_tier, collection_priority, entity_id LIMIT 40) s CROSS JOIN (SELECT * FROM (VALUES ('station_generation', '1999'), ('station_generation', '2000'), ('station_capacity', '-')) k(kind, period)) y
  UNION ALL SELECT entity_id || '::' || kind || '::-', NULL, NULL FROM projects CROSS JOIN (SELECT unnest(['project_status', 'project_commissioning']) AS kind) y""")
def _(s, p):
    empty = {"priority_tier": F.lit(None).cast("string"), "collection_priority": F.lit(None).cast("int")}
    return fr.generate_tasks(s, p.withColumns(empty), ["1999", "2000"], station_limit=40).select("task_id", "priority_tier", "collection_priority")


@query("retryable", "tasks", "SELECT task_id FROM tasks WHERE status = 'failed' AND attempts < max_attempts")
def _(x):
    return x.where("status = 'failed' and attempts < max_attempts").select("task_id")


UPDATES = "(SELECT 'P' || task_id entity_id, status, seq, ts FROM transitions)"


@query("project_status_update", "projects transitions", f"SELECT p.entity_id, coalesce(u.status, p.status) status FROM projects p LEFT JOIN (SELECT entity_id, arg_max(status, seq) status FROM {UPDATES} u GROUP BY entity_id) u ON u.entity_id = p.entity_id")
def _(p, h):
    return fr.status_updates(p, _updates(h))[0].select("entity_id", "status")


@query("project_status_history", "projects transitions", f"SELECT u.entity_id, coalesce(lag(u.status) OVER (PARTITION BY u.entity_id ORDER BY seq), p.status) old_status, u.status new_status, u.seq FROM {UPDATES} u JOIN projects p ON p.entity_id = u.entity_id")
def _(p, h):
    return fr.status_updates(p, _updates(h))[1].select("entity_id", "old_status", "new_status", "seq")


def _updates(h):
    return h.select(F.concat(F.lit("P"), "task_id").alias("entity_id"), "status", "seq")


ENTITIES = "known_entities new_entities"
UP = "SELECT coalesce(o.entity_id, n.entity_id) entity_id, coalesce(n.a, o.a) a, {} status FROM known_entities o FULL JOIN new_entities n ON n.entity_id = o.entity_id"


@query("insert_absent", ENTITIES, "SELECT entity_id, a, status FROM known_entities UNION ALL SELECT entity_id, a, status FROM new_entities n WHERE NOT EXISTS (SELECT 1 FROM known_entities o WHERE o.entity_id = n.entity_id)")
def _(old, new):
    return fr.insert_absent(old, new, ["entity_id"])


@query("upsert", ENTITIES, UP.format("CASE WHEN n.entity_id IS NULL THEN o.status ELSE n.status END"))
def _(old, new):
    return fr.upsert(old, new, ["entity_id"])


@query("review_upsert", ENTITIES, UP.format("coalesce(o.status, n.status)"))
def _(old, new):
    """The first status that is known stays."""
    return fr.upsert(old, new, ["entity_id"], {"status": fr.first_known})


@query("discovery_upsert", ENTITIES, UP.format("CASE WHEN n.entity_id IS NULL OR o.status IN ('official', 'authority') THEN o.status ELSE n.status END"))
def _(old, new):
    return fr.upsert(old, new, ["entity_id"], {"status": fr.survives("official", "authority")})


@query("sheet_union", "stations projects", "SELECT entity_id, 'stations' _sheet, latitude FROM stations UNION ALL SELECT entity_id, 'projects', NULL FROM projects")
def _(s, p):
    return s.select("entity_id", F.lit("stations").alias("_sheet"), "latitude").unionByName(p.select("entity_id", F.lit("projects").alias("_sheet")), allowMissingColumns=True)


BUILT = """(SELECT 'GEM-' || coalesce(nullif(trim(unit), ''), nullif(trim(location), ''), 'ROW-' || lpad(cast(c_custkey AS string), 6, '0')) entity_id, CASE WHEN lower(trim(status)) IN ('operating', 'retired', 'mothballed') THEN 'station' WHEN trim(status) <> '' THEN 'project' ELSE 'unknown' END entity_type, nullif(trim(name), '') canonical_name,
  CASE WHEN lower(trim(status)) <> 'operating' THEN 'D' WHEN cap >= 1000 THEN 'A' WHEN cap >= 300 THEN 'B' ELSE 'C' END tier, cap, cap IS NULL OR NOT coalesce(try_cast(latitude AS double), 0) BETWEEN -90 AND 90 OR NOT coalesce(try_cast(longitude AS double), 0) BETWEEN -180 AND 180 needs_review,
  sha256(concat_ws('|', trim(location), trim(unit), trim(name), trim(capacity), trim(status), trim(country), '')) hash FROM (SELECT *, try_cast(trim(capacity) AS double) cap FROM raw_rows) z)"""


@query("build_registry", "raw_rows", f"SELECT entity_id, entity_type, canonical_name, tier, CASE tier WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 ELSE 4 END priority, round(cap, 4) capacity_mw, needs_review, hash FROM {BUILT} b")
def _(x):
    """Stations, projects and the rest, which `split_registry` parts."""
    built = rg.build_registry(x.withColumn("ordinal", F.col("c_custkey")))
    return built.select("entity_id", "entity_type", "canonical_name", F.col("priority_tier").alias("tier"), F.col("collection_priority").alias("priority"), F.round("capacity_mw", 4).alias("capacity_mw"), "needs_review", F.col("raw_record_hash").alias("hash"))


@query("registry_order", "raw_rows", f"SELECT entity_type, entity_id, row_number() OVER (PARTITION BY entity_type ORDER BY CASE tier WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 ELSE 4 END, cap DESC NULLS LAST, entity_id) AS place FROM {BUILT} b WHERE entity_type <> 'unknown'")
def _(x):
    stations, projects = rg.split_registry(rg.build_registry(x.withColumn("ordinal", F.col("c_custkey"))))
    order = [F.asc("collection_priority"), F.desc_nulls_last("capacity_mw"), F.asc("entity_id")]
    return t.ranked(stations.unionByName(projects), ["entity_type"], order, F.col("collection_priority") * 1e9 - F.coalesce("capacity_mw", F.lit(-1e6)), "place").select("entity_type", "entity_id", "place")


@query("quota_admit", "events")
def _(e):
    return jobs.quota_admit(jobs.provider_calls(e), budget=4, failures=2)


LEASES = """(SELECT user_id task_id, CASE event_type WHEN 'signup' THEN 'claim' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'done' ELSE 'other' END kind, event_id % 3 worker, ts, event_id FROM events)"""


@query("lease_expiry", "events", f"""WITH e AS (SELECT *, last(CASE WHEN kind = 'claim' THEN worker END IGNORE NULLS) OVER w holder FROM {LEASES} l WHERE kind <> 'other' WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id)),
  f AS (SELECT *, last(CASE WHEN kind = 'claim' OR (kind = 'heartbeat' AND worker = holder) THEN ts END IGNORE NULLS) OVER (PARTITION BY task_id ORDER BY ts, event_id) seen FROM e),
  g AS (SELECT task_id, arg_max(kind, (ts, event_id)) FILTER (WHERE kind IN ('claim', 'done')) state, max(seen) seen, count(CASE WHEN kind = 'claim' THEN 1 END) claims FROM f GROUP BY task_id)
  SELECT task_id, seen last_seen, claims attempts, 'failed' status FROM g WHERE state = 'claim' AND epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(seen) > 3600""")
def _(e):
    return jobs.lease_expiry(jobs.leases(e), "2024-01-31 00:00:00", 3600)


@query("idempotent_ingest", "events", "SELECT event_id, user_id FROM events")
def _(e):
    return jobs.idempotent_ingest(e.union(e.where("event_id % 3 = 0"))).select("event_id", "user_id")


SEEDS = """(SELECT c_custkey, CASE WHEN c_custkey % 31 = 7 THEN '' ELSE 'E' || cast(c_custkey AS string) END entity_id, CASE WHEN c_custkey % 37 = 8 THEN ' ' WHEN c_custkey % 5 = 0 THEN 'The "' || c_name || '",' || chr(10) || 'east' ELSE ' ' || c_name || ' ' END canonical_name,
  CASE WHEN c_custkey % 4 = 1 THEN 'n/a' ELSE cast(c_acctbal AS string) END capacity_mw, cast(c_custkey % 99 AS string) latitude, cast(1950 + c_custkey % 70 AS string) || '.0' commissioning_year, CASE WHEN c_custkey % 2 = 0 THEN '2 x 50 MW; 3' ELSE 'many' END turbines, CASE c_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' END needs_review FROM customer)"""


@query("seed_scan", "customer", f"""SELECT entity_id, canonical_name, capacity_mw, latitude, commissioning_year, turbines, needs_review, why FROM (SELECT nullif(trim(entity_id), '') entity_id, nullif(trim(canonical_name), '') canonical_name, try_cast(capacity_mw AS double) capacity_mw, cast(latitude AS double) latitude, cast(cast(commissioning_year AS double) AS int) commissioning_year,
  CASE WHEN turbines = 'many' THEN NULL ELSE 5 END turbines, coalesce(needs_review, '') = 'Yes' needs_review, NULL why FROM {SEEDS} s) x WHERE entity_id IS NOT NULL AND canonical_name IS NOT NULL AND latitude <= 90
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN trim(entity_id) = '' THEN 'entity_id' WHEN trim(canonical_name) = '' THEN 'canonical_name' ELSE 'place' END FROM {SEEDS} s WHERE trim(entity_id) = '' OR trim(canonical_name) = '' OR cast(latitude AS int) > 90""")
def _(x):
    """The table as CSV files, read back: names with quotes, commas and line ends, bad numbers, rows that must not be loaded."""
    path = scratch(x.sparkSession, "seed")
    x.createOrReplaceTempView("wattline_seed_rows")
    rows = x.sparkSession.sql(f"SELECT * FROM {SEEDS.replace('FROM customer)', 'FROM wattline_seed_rows)')} s")
    rows.drop("c_custkey").write.option("header", True).option("escape", '"').csv(path)
    loaded, rejects = read_seed(x.sparkSession, path)
    fields = ["entity_id", "canonical_name", "capacity_mw", "latitude", "commissioning_year", "turbines", "needs_review"]
    return loaded.select(*fields, F.lit(None).cast("string").alias("why")).union(rejects.select(*[F.lit(None).cast(loaded.schema[c].dataType) for c in fields], "why"))


@query("locator_meta", "locators", "SELECT doc_id, page, table_ref FROM locators")
def _(x):
    page, table = fa.locator_meta(F.col("locator"))
    return x.select("doc_id", page.alias("page"), table.alias("table_ref"))


@query("llm_contract", "answers", "SELECT doc_id, valid, flags FROM answers")
def _(a):
    """Answers must hold exactly the known fields with values of their kinds; what they say is flagged like what rules find."""
    return fa.llm_candidates(a, "doc_id", "body").select("doc_id", "valid", F.array_join(F.coalesce(F.get("candidates", F.lit(0))["flags"], F.array().cast("array<string>")), ",").alias("flags"))


@query("extract_tables", "fact_pages page_facts", "SELECT doc_id, locator, period_label, value_raw, unit_raw, round(gwh, 6) gwh, metric, measurement_scope FROM page_facts")
def _(pages, _expected):
    parsed = ex.parse_pages(pages.select("doc_id", F.array("name").alias("names"), "html"))
    return fa.extract_tables(parsed, "doc_id", "names").select("doc_id", "locator", "period_label", "value_raw", "unit_raw", F.round("generation_gwh", 6).alias("gwh"), "metric", "measurement_scope")


@query("entity_country_conflict", "homes", """SELECT doc_id, CASE WHEN doc_id % 40 = 33 THEN 'unknown_source' WHEN doc_id % 40 = 34 THEN 'unknown_entity' WHEN doc_id % 40 = 35 AND country <> 'US' THEN 'source_country' WHEN doc_id % 40 = 35 AND why = 'source_country' AND country = 'US' THEN NULL ELSE why END why, doc_id % 40 <> 34 AND doc_id % 40 <> 33 AND doc_id % 3 = 0 AS named FROM homes""")
def _(h):
    """Candidates with a source and evidence of their own; some have no known source or entity, some an address of evidence in another country."""
    k = F.col("doc_id") % 40
    ident = F.col("doc_id").cast("string")
    candidates = h.select("doc_id", ident.alias("entity_id"), ident.alias("source_id"), ident.alias("evidence_id"))
    stations = h.where(k != 34).select(ident.alias("entity_id"), "country", F.concat(F.lit(" Big  Dam No. "), ident).alias("canonical_name"))
    sources = h.where(k != 33).select(ident.alias("source_id"), "url", F.when(F.col("doc_id") % 3 == 0, "the BIG DAM no. 7").otherwise("a page").alias("title"))
    evidence = h.select(ident.alias("evidence_id"), F.col("text").alias("snippet"), F.when(k == 35, "https://www.eia.gov/other").otherwise(F.col("url")).alias("source_url"))
    out = lo.attribution(candidates, stations, sources, evidence, di.source_country, di.home_conflict)
    return out.select("doc_id", "why", F.coalesce("named", F.lit(False)).alias("named"))


LINKED = """, found AS (SELECT page_id, url, nth, href, CASE WHEN href LIKE 'http%' THEN href ELSE regexp_extract(url, '^([^/?#]*//[^/?#]*)', 1) || href END full_url FROM (SELECT page_id, url, 1 nth, '/files/annual-report-' || cast(page_id % 40 AS string) || '.pdf' href FROM pages
  UNION ALL SELECT page_id, url, 2, '/data.csv?v=2' FROM pages UNION ALL SELECT page_id, url, 3, 'https://other.example/' || cast(page_id % 3 AS string) || '.xlsx' FROM pages) z) """


@query("link_filter", "linked_pages pages", LINKED + """SELECT 'any' AS wanted, page_id, href FROM found UNION ALL SELECT 'year', page_id, '/files/annual-report-' || cast(page_id % 40 AS string) || '.pdf' FROM pages UNION ALL SELECT 'year', page_id, '/y/2018/x.csv' FROM pages UNION ALL SELECT 'year', page_id, '/report/z' FROM pages""")
def _(p, _pages):
    """Links of a page that look like documents or reports, eight for each page, by place; and, with more links, those that may be of 2019."""
    more = F.lit('<a href="/y/2018/x.csv">t</a><a href="/y/2016/x.csv">t</a><a href="/report/z">of 2020</a><a href="/report/w">of 2021</a>')
    dated = ex.document_links(ex.parse_pages(p.withColumn("html", F.concat("html", more))), year=2019)
    return ex.document_links(ex.parse_pages(p)).select(F.lit("any").alias("wanted"), "page_id", "href").union(dated.select(F.lit("year"), "page_id", "href"))


@query("expand_attachments", "linked_pages pages", LINKED + r"""SELECT page_id, full_url url, url parent_url, CASE WHEN full_url LIKE '%.pdf' THEN 'pdf' WHEN full_url LIKE '%.xlsx' THEN 'excel' ELSE 'csv' END document_type, 'cand_' || substr(sha256(trim(url) || chr(31) || full_url), 1, 20) id FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id, nth) k
  FROM (SELECT *, regexp_replace(regexp_extract(lower(url), '^[^/?#]*//([^/?#]*)', 1), '^www\.', '') site, row_number() OVER (PARTITION BY lower(full_url) ORDER BY page_id, nth) once FROM found f) x WHERE once = 1) y WHERE k <= 20""")
def _(p, known):
    """Links that look like documents, as candidates of their own; the pages of one host are a group."""
    links = ex.document_links(ex.parse_pages(p)).join(p.select("page_id", "url"), "page_id")
    return di.expand_attachments(links.withColumn("group", tx.publisher_domain(F.col("url"))), known.select("url")).drop("at")


@query("slug", "stations", "SELECT entity_id, regexp_replace(upper(canonical_name), '[^A-Z0-9]+', '-', 'g') slug FROM stations")
def _(s):
    return s.select("entity_id", tx.slug(F.col("canonical_name")).alias("slug"))


@query("compact_name", "stations", "SELECT entity_id, regexp_replace(lower(canonical_name), '[^a-z0-9]', '', 'g') compact FROM stations")
def _(s):
    return s.select("entity_id", tx.compact_name(F.col("canonical_name")).alias("compact"))


@query("full_year_clue", "clues", "SELECT doc_id, full_year clue FROM clues")
def _(s):
    return s.select("doc_id", tx.full_year_clue(F.col("text")).alias("clue"))


@query("metric_clue", "clues", "SELECT doc_id, metric FROM clues")
def _(s):
    return s.select("doc_id", tx.metric_clue(F.col("text")).alias("metric"))


@query("value_type_clue", "clues", "SELECT doc_id, value_type kind FROM clues")
def _(s):
    return s.select("doc_id", tx.value_type_clue(F.col("text")).alias("kind"))


@query("scope_clue", "clues", "SELECT doc_id, scope FROM clues")
def _(s):
    return s.select("doc_id", tx.scope_clue(F.col("text")).alias("scope"))


@query("period_type", "clues", "SELECT doc_id, period FROM clues")
def _(s):
    return s.select("doc_id", tx.period_type(F.col("text")).alias("period"))


@query("sentence_ctx", "fact_texts fact_sentences", "SELECT doc_id, nth, snippet FROM fact_sentences")
def _(texts, _expected):
    return fa.text_figures(texts, ["doc_id"], "text").select("doc_id", F.col("at").alias("nth"), "snippet")


@query("layout_tables", "layout_pages layout_found", "SELECT doc_id, first_page, last_page, headers, cells FROM layout_found")
def _(pages, _expected):
    """Tables with headers of two lines, tables that go on with and without a header, two on a page, texts that are none."""
    merged, _ = la.page_tables(pages, "doc_id", "page", "text")
    return merged.select("doc_id", "first_page", "last_page", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("cells"))


@query("merge_page_tables", "layout_pages layout_notes", "SELECT doc_id, previous_page, page, reasons FROM layout_notes")
def _(pages, _expected):
    """Why tables on neighbouring pages are not one."""
    _, notes = la.page_tables(pages, "doc_id", "page", "text")
    return notes.select("doc_id", F.coalesce("previous_page", F.lit(0)).alias("previous_page"), "page", F.array_join("reasons", ",").alias("reasons"))


@query("extract_rows", "row_texts row_facts", "SELECT doc_id, nth, 'text.station_row[' || station || ']' locator, period_label, value_raw, unit_raw, round(gwh, 6) gwh, 'gross_generation' metric, 'calendar_year' period_type FROM row_facts")
def _(rows, _expected):
    """Several stations, forms of a name, names that are part of others, texts without year, unit or whole year."""
    out = extract_rows(rows.select("doc_id", "text", F.split("names", "[|]").alias("names")), "doc_id", "text", "names")
    return out.select("doc_id", F.col("at").alias("nth"), "locator", "period_label", "value_raw", "unit_raw", F.round("generation_gwh", 6).alias("gwh"), "metric", "period_type")


@query("extract_all", "fact_pages page_facts", """SELECT doc_id, locator, period_label, unit_raw, round(gwh, 6) gwh FROM page_facts
  UNION ALL SELECT doc_id, 'text', regexp_extract(html, '<p>In ([0-9]+)', 1), 'GWh', cast(regexp_extract(html, 'generation ([0-9]+) GWh</p>', 1) AS double) FROM fact_pages WHERE doc_id % 6 = 4
  UNION ALL SELECT doc_id, 'text.station_row[' || name || ']', regexp_extract(html, 'year ([0-9]+)', 1), 'GWh', cast(regexp_extract(html, '2% ([0-9]+)', 1) AS double) FROM fact_pages WHERE doc_id % 6 = 5""")
def _(pages, _expected):
    parsed = ex.parse_pages(pages.select("doc_id", F.array("name").alias("names"), "html"))
    return fa.extract_all(parsed, "doc_id", "names").select("doc_id", "locator", "period_label", "unit_raw", F.round("generation_gwh", 6).alias("gwh"))


def _id(key: str, sql: str, column):
    query(key, "records", f"SELECT id, {sql} AS value FROM records")(lambda r: r.select("id", column().alias("value")))


_K = F.col


_id("id_task", "entity_id || '::generation::' || period_label || CASE WHEN period_type <> 'calendar_year' THEN '::' || period_type ELSE '' END", lambda: tx.task_id(_K("entity_id"), F.lit("generation"), _K("period_label"), _K("period_type")))
_id("id_document", "'doc_' || substr(sha1(source_id || '::' || candidate_id), 1, 16)", lambda: tx.short_id("doc_", _K("source_id"), _K("candidate_id")))
_id("id_source", "'src_' || substr(sha1(source_id || '::' || candidate_id), 1, 16)", lambda: tx.short_id("src_", _K("source_id"), _K("candidate_id")))
def _fact():
    return F.concat_ws("|", *[F.coalesce(_K(c), F.lit("")) for c in ("entity_id", "period_type", "period_label", "value_type", "measurement_scope", "metric")])


_FACT_SQL = "entity_id || '|' || period_type || '|' || period_label || '|' || value_type || '|' || measurement_scope"
_id("id_evidence", f"'ev_' || substr(sha1('generation::' || {_FACT_SQL} || '|' || metric || '::' || coalesce(evidence_id, '')), 1, 16)", lambda: tx.short_id("ev_", F.lit("generation"), _fact(), _K("evidence_id")))
_id("id_review", f"'rv_' || substr(sha1(entity_id || '::generation::' || {_FACT_SQL}), 1, 16)", lambda: tx.short_id("rv_", _K("entity_id"), F.lit("generation"), F.concat_ws("|", "entity_id", "period_type", "period_label", "value_type", "measurement_scope")))
_id("id_lead", "'lead_' || substr(sha256(entity_id || chr(31) || coalesce(evidence_id, '') || chr(31) || source_id), 1, 20)", lambda: tx.stable_id("lead_", _K("entity_id"), _K("evidence_id"), _K("source_id")))
_id("id_candidate_source", "'cs_' || substr(sha256(source_id || chr(31) || entity_id), 1, 20)", lambda: tx.stable_id("cs_", _K("source_id"), _K("entity_id")))
_id("id_attempt", "'att_' || substr(sha256(source_id || chr(31) || cast(id AS string)), 1, 20)", lambda: tx.stable_id("att_", _K("source_id"), _K("id").cast("string")))
_id("lineage_hash", "sha256(candidate_id || '::' || coalesce(evidence_id, '') || '::' || source_id)", lambda: F.sha2(F.concat_ws("::", "candidate_id", F.coalesce("evidence_id", F.lit("")), "source_id"), 256))

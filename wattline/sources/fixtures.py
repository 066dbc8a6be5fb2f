"""Domain frames over the given tables, as SQL that both Spark and DuckDB run, but for three that Spark makes in another way (SPARK_FRAMES)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattline.sources import phrases as ph

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

#: In order of dependence. Ids are strings as in the domain; years are ints.
FRAMES: dict[str, str] = {
    "stations": """SELECT cast(c_custkey AS string) entity_id, 'station' entity_type, c_name canonical_name,
        c_name || ';' || lower(c_mktsegment) aliases, n_name country, r_name region, c_mktsegment operator,
        greatest(c_acctbal, 0.0e0) * 2 capacity_mw, cast(1950 + c_custkey % 70 AS int) commissioning_year,
        CASE WHEN c_acctbal * 2 >= 10000 THEN 'A' WHEN c_acctbal * 2 >= 5000 THEN 'B' ELSE 'C' END priority_tier,
        cast(c_custkey % 5 AS int) collection_priority, cast(c_custkey % 200 - 98 AS double) latitude, cast(c_custkey % 380 - 185 AS double) longitude,
        CASE WHEN c_custkey % 9 = 0 THEN 'retired' ELSE 'operating' END status
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "projects": """SELECT 'P' || cast(s_suppkey AS string) entity_id,
        CASE WHEN s_suppkey % 2 = 0 THEN upper('Customer#' || lpad(cast(s_suppkey AS string), 9, '0')) || ' ' ELSE 'Customer#' || lpad(cast(s_suppkey AS string), 9, '0') END canonical_name,
        n_name country, s_acctbal capacity_mw, cast(1950 + s_suppkey % 70 AS int) commissioning_year,
        CASE s_suppkey % 4 WHEN 0 THEN 'newly_commissioned' WHEN 1 THEN 'under_construction' WHEN 2 THEN 'approved' ELSE 'announced' END status
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "records": """SELECT o_orderkey id, cast(o_custkey AS string) entity_id,
        CASE WHEN o_orderkey % 10 = 1 THEN 'fiscal_year' ELSE 'calendar_year' END period_type, cast(year(o_orderdate) AS string) period_label,
        CASE WHEN o_orderkey % 10 = 0 THEN 'forecast' ELSE 'actual' END value_type, CASE WHEN o_orderkey % 37 = 1 THEN 'region' ELSE 'plant' END measurement_scope, CASE WHEN o_orderkey % 19 = 1 THEN 'net_generation' ELSE 'gross_generation' END metric, CASE WHEN o_orderkey % 59 = 3 THEN 'mwh' ELSE 'gwh' END normalized_unit,
        o_totalprice / 100 generation_gwh, 'src_' || cast(o_orderkey % 100 AS string) source_id,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'E' || cast(o_orderkey AS string) || '-1' END evidence_id, 'C' || cast(o_orderkey AS string) candidate_id,
        cast(6 - cast(substr(o_orderpriority, 1, 1) AS int) AS double) / 5 confidence,
        CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'P' THEN 'failed' ELSE 'pending' END validation_status,
        CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'rejected' ELSE 'open' END review_status,
        CASE o_orderstatus WHEN 'F' THEN 'publishable' WHEN 'P' THEN 'withheld' ELSE 'draft' END publication_status,
        o_orderdate created_at, o_orderdate updated_at FROM orders""",
    "candidates": """SELECT 'C' || cast(o_orderkey AS string) candidate_id, 'T' || cast(o_orderkey AS string) task_id, cast(o_custkey AS string) entity_id,
        CASE WHEN o_orderkey % 10 = 1 THEN 'fiscal_year' ELSE 'calendar_year' END period_type, cast(year(o_orderdate) AS string) period_label,
        CASE WHEN o_orderkey % 10 = 0 THEN 'forecast' WHEN o_orderkey % 43 = 2 THEN NULL ELSE 'actual' END value_type, CASE WHEN o_orderkey % 37 = 1 THEN 'region' ELSE 'plant' END measurement_scope,
        CASE WHEN o_orderkey % 19 = 0 THEN 'unknown' WHEN o_orderkey % 19 = 1 THEN 'net_generation' ELSE 'gross_generation' END metric, 'gwh' normalized_unit,
        CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice / 50 WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_totalprice / 100 END generation_gwh,
        CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE cast(6 - cast(substr(o_orderpriority, 1, 1) AS int) AS double) / 5 END confidence,
        CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'rejected' ELSE 'pending' END review_status, o_orderdate extracted_at,
        CASE WHEN o_orderkey % 7 = 3 THEN 'doc_' || cast(o_orderkey % 50 AS string) ELSE e.document_id END document_id, 'src_' || cast(o_orderkey % 100 AS string) source_id,
        cast(o_totalprice AS string) value_raw, CASE o_orderkey % 41 WHEN 5 THEN 'MW' WHEN 6 THEN 'hours' ELSE 'GWh' END unit_raw, 'line ' || cast(o_orderkey AS string) snippet,
        CASE o_orderkey % 31 WHEN 0 THEN 'UNIT_UNCLEAR' WHEN 1 THEN 'UNIT_NOT_ENERGY,CAPACITY_SUSPECT' WHEN 2 THEN 'PERIOD_UNCLEAR' WHEN 3 THEN 'OCR_DERIVED' ELSE '' END flags
        FROM orders LEFT JOIN (SELECT evidence_id, document_id FROM evidence) e ON e.evidence_id = 'E' || cast(o_orderkey AS string) || '-1'""",
    "candidate_evidence": """SELECT DISTINCT 'C' || cast(l_orderkey AS string) candidate_id, 'E' || cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) evidence_id
        FROM lineitem WHERE l_linenumber % 7 <> 0""",
    "evidence": """SELECT evidence_id, document_id, content_hash, fact_type, page_number, created_at FROM (
        SELECT 'E' || cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) evidence_id, 'doc_' || cast(l_suppkey AS string) document_id,
        CASE WHEN l_suppkey % 11 = 0 THEN 'stale' ELSE 'h' || cast(l_suppkey AS string) END content_hash, 'generation' fact_type, cast(l_linenumber AS int) page_number, l_shipdate created_at,
        row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey, l_extendedprice) rn FROM lineitem) x WHERE rn = 1""",
    "archive": """SELECT 'doc_' || cast(s_suppkey AS string) document_id, 'h' || cast(s_suppkey AS string) content_hash, 'src_' || cast(s_suppkey % 100 AS string) source_id,
        'https://example.org/' || cast(s_suppkey AS string) original_url, CASE s_suppkey % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' ELSE 'csv' END content_kind,
        cast(s_suppkey * 100 + 7 AS bigint) file_size FROM supplier""",
    "sources": """SELECT 'src_' || cast(s_suppkey % 100 AS string) source_id, s_name title, 'https://s' || cast(s_suppkey AS string) || CASE s_suppkey % 3 WHEN 0 THEN '.gov' WHEN 1 THEN '.org' ELSE '.com' END || '/annual/2019.pdf' url,
        cast(s_suppkey AS string) entity_id, CASE s_suppkey % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'authority' ELSE 'other' END source_type, CASE WHEN s_suppkey % 5 = 2 THEN 'net_generation' ELSE 'gross_generation' END covered_metric,
        CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE cast(1995 + s_suppkey % 7 AS int) END covered_year, (s_acctbal + 1000) / 11000 source_reliability_score,
        coalesce(ok, 0) success_count, coalesce(bad, 0) failure_count, last_ok last_success, last_bad last_failure
        FROM supplier LEFT JOIN (SELECT user_id % 100 uid, sum(CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END) ok, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) bad,
        max(CASE WHEN event_type IN ('view', 'click', 'purchase') THEN ts END) last_ok, max(CASE WHEN event_type = 'error' THEN ts END) last_bad FROM events GROUP BY user_id % 100) e ON e.uid = s_suppkey""",
    "tasks": """SELECT 'T' || cast(o_orderkey AS string) task_id, CASE WHEN o_orderkey % 3 = 0 THEN 'P' || cast(o_custkey % 100 AS string) ELSE cast(o_custkey AS string) END entity_id,
        CASE WHEN o_orderkey % 3 = 0 THEN 'project' ELSE 'station' END entity_type, 'generation' task_type, cast(year(o_orderdate) + CASE WHEN o_orderkey % 47 = 3 THEN 1 ELSE 0 END AS string) target_period,
        CASE WHEN o_orderkey % 53 = 4 THEN 'fiscal_year' ELSE 'calendar_year' END task_period_type,
        CASE o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'success' WHEN 3 THEN 'failed' WHEN 4 THEN 'needs_review' ELSE 'cancelled' END status,
        CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END priority_tier, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE cast(o_orderkey % 7 AS int) END collection_priority,
        cast(o_orderkey % 4 AS int) attempts, 3 max_attempts, CASE WHEN o_orderkey % 6 = 3 THEN 'extraction' END failure_stage, o_orderdate created_at, o_orderdate updated_at FROM orders""",
    "reviews": """SELECT 'rv_' || cast(o_orderkey AS string) review_id, 'C' || cast(o_orderkey AS string) candidate_id, cast(o_custkey AS string) entity_id,
        CASE WHEN o_orderkey % 2 = 0 THEN 'generation' ELSE 'capacity' END fact_type, cast(o_custkey AS string) || '|' || cast(year(o_orderdate) AS string) fact_key, o_orderpriority reason,
        CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'rejected' ELSE 'open' END status,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'T' || cast(o_orderkey AS string) END task_id, o_orderdate created_at FROM orders""",
    "whole_chains": """SELECT ce.candidate_id, min(CASE WHEN e.content_hash = d.content_hash THEN 1 ELSE 0 END) whole, min(e.evidence_id) first_evidence FROM candidate_evidence ce
        LEFT JOIN evidence e ON e.evidence_id = ce.evidence_id LEFT JOIN archive d ON d.document_id = e.document_id GROUP BY ce.candidate_id""",
    "decisions": """SELECT o_orderkey decision_id, 'rv_' || cast(o_orderkey AS string) review_id, CASE o_orderkey % 7 WHEN 0 THEN 'reject' WHEN 1 THEN 'cancel' WHEN 2 THEN 'request_more_evidence' WHEN 3 THEN 'maybe' ELSE 'approve' END decision,
        'r' || cast(o_orderkey % 3 AS string) reviewer, CASE WHEN o_orderkey % 4 = 0 THEN 'not enough' END reason, o_orderdate decided_at FROM orders
        UNION ALL SELECT o_orderkey + 100000000, 'rv_' || cast(o_orderkey AS string), 'reject', 'r9', NULL, o_orderdate FROM orders WHERE o_orderkey % 5 = 0
        UNION ALL SELECT c_custkey + 200000000, 'rv_none' || cast(c_custkey AS string), 'approve', 'r8', NULL, NULL FROM customer""",
    "import_rows": """SELECT o_orderkey AS row, CASE WHEN o_orderkey % 29 = 7 THEN 'nobody' ELSE cast(o_custkey AS string) END entity_id, CASE WHEN o_orderkey % 23 = 4 THEN '95' ELSE cast(year(o_orderdate) AS string) END period_label,
        CASE WHEN o_orderkey % 31 = 2 THEN 'quarter' ELSE 'calendar_year' END period_type, CASE WHEN o_orderkey % 37 = 5 THEN 'net_generation' ELSE 'Gross_Generation' END metric,
        CASE WHEN o_orderkey % 19 = 3 THEN '' WHEN o_orderkey % 19 = 4 THEN '-5' WHEN o_orderkey % 19 = 5 THEN 'many' ELSE cast(cast(floor(o_totalprice) AS bigint) AS string) END generation_gwh,
        CASE WHEN o_orderkey % 41 = 9 THEN 'MW' WHEN o_orderkey % 2 = 0 THEN '万千瓦时' ELSE ' GWh' END unit_raw, CASE WHEN o_orderkey % 43 = 11 THEN 'forecast' ELSE 'Actual' END value_type, CASE WHEN o_orderkey % 47 = 13 THEN 'region' ELSE 'plant' END measurement_scope,
        CASE WHEN o_orderkey % 17 = 1 THEN '1.5' WHEN o_orderkey % 17 = 2 THEN '' WHEN o_orderkey % 17 = 3 THEN 'high' ELSE '0.8' END confidence, CASE WHEN o_orderkey % 13 = 6 THEN 'Another name' ELSE c_name END canonical_name
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "transitions": """SELECT cast(user_id AS string) task_id, event_id seq, ts, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' ELSE 'needs_review' END status FROM events""",
    "links": """SELECT 'P' || cast(s_suppkey AS string) project_id, cast(s_suppkey AS string) station_id, 'becomes' link_type, cast(1950 + s_suppkey % 70 AS string) || '-01-01' effective_date FROM supplier WHERE s_suppkey % 3 = 0
        UNION ALL SELECT 'P' || cast(s_suppkey AS string), cast(s_suppkey + 1 AS string), 'expands', CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE '2001-01-01' END FROM supplier WHERE s_suppkey % 2 = 0""",
    "ground_truth": """SELECT o_orderkey case_id, cast(o_custkey AS string) entity_id, cast(year(o_orderdate) AS string) period_label, o_totalprice / 100 * (1 + cast(o_orderkey % 7 - 3 AS double) / 50) expected FROM orders WHERE o_orderkey % 5 = 0""",
    "versions": """SELECT DISTINCT 'https://example.org/' || cast(l_suppkey AS string) url, 'h' || cast(l_partkey AS string) content_hash, l_shipdate fetched_at FROM lineitem""",
    "sentences": """SELECT o_orderkey doc_id, cast(year(o_orderdate) AS string) want_year, cast(o_totalprice AS string) want_value, CASE o_orderkey % 4 WHEN 0 THEN 'GWh' WHEN 1 THEN 'MWh' WHEN 2 THEN 'TWh' ELSE 'MW' END want_unit,
        'Station ' || c_name || ' actual annual generation in ' || cast(year(o_orderdate) AS string) || ' was ' || cast(o_totalprice AS string) || ' ' || CASE o_orderkey % 4 WHEN 0 THEN 'GWh' WHEN 1 THEN 'MWh' WHEN 2 THEN 'TWh' ELSE 'MW' END || CASE o_orderkey % 3 WHEN 0 THEN ' net generation' WHEN 1 THEN ' forecast' ELSE '' END text
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "order_values": """SELECT o_orderkey doc_id, cast(year(o_orderdate) AS string) y, cast(year(o_orderdate) + 1 AS string) z, translate(cast(cast(floor(o_totalprice) AS bigint) + 1000000 AS string), '1290', '3456') v, c_name n FROM orders JOIN customer ON c_custkey = o_custkey""",
    "clues": f"SELECT doc_id, text, period, metric, nullif(value_type, '') value_type, nullif(scope, '') scope, full_year FROM order_values JOIN {ph.values(ph.CLUES, 'text', 'period', 'metric', 'value_type', 'scope', 'full_year')} c ON k = doc_id % {len(ph.CLUES)}",
    "units": f"SELECT doc_id, unit, kind, nullif(factor, -1.0e0) factor FROM order_values JOIN {ph.values(ph.UNITS, 'unit', 'kind', 'factor')} c ON k = doc_id % {len(ph.UNITS)}",
    "numbers": f"SELECT doc_id, raw, nullif(number, -1.0e0) number FROM order_values JOIN {ph.values(ph.NUMBERS, 'raw', 'number')} c ON k = doc_id % {len(ph.NUMBERS)}",
    "urls": f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' HTTPS://Www.H' ELSE 'https://u@h' END || cast(doc_id % 50 AS string) || '.Example.org' || rest url, 'https://' || CASE doc_id % 3 WHEN 0 THEN 'www.h' ELSE 'h' END || cast(doc_id % 50 AS string) || '.example.org' || fixed canonical FROM order_values JOIN {ph.values(ph.URLS, 'rest', 'fixed')} c ON k = doc_id % {len(ph.URLS)}",
    "year_lists": f"SELECT doc_id, replace(replace(text, '{{Y}}', y), '{{Z}}', z) text, replace(replace(listed, '{{Y}}', y), '{{Z}}', z) listed FROM order_values JOIN {ph.values(ph.YEAR_LISTS, 'text', 'listed')} c ON k = doc_id % {len(ph.YEAR_LISTS)}",
    "fact_texts": f"SELECT doc_id, replace(replace(replace(text, '{{Y}}', y), '{{Z}}', z), '{{V}}', v) text FROM order_values JOIN {ph.values(ph.FACT_TEXTS, 'text')} c ON k = doc_id % {len(ph.FACT_TEXTS)}",
    "facts": f"SELECT doc_id, nth, CASE yr WHEN 'Y' THEN y WHEN 'Z' THEN z END period_label, v value_raw, unit unit_raw, cast(v AS double) * nullif(factor, -1.0e0) gwh, metric, nullif(value_type, '') value_type, nullif(scope, '') measurement_scope, nullif(period, '') period_type, flags FROM order_values JOIN {ph.values(ph.FACTS, 'txt', 'nth', 'yr', 'unit', 'factor', 'metric', 'value_type', 'scope', 'period', 'flags')} c ON txt = doc_id % {len(ph.FACT_TEXTS)}",
    "fact_pages": f"SELECT doc_id, 'Dam ' || n AS name, replace(replace(replace(replace(html, '{{Y}}', y), '{{Z}}', z), '{{V}}', v), '{{N}}', 'Dam ' || n) html FROM order_values JOIN {ph.values(ph.FACT_PAGES, 'html')} c ON k = doc_id % {len(ph.FACT_PAGES)}",
    "page_facts": f"SELECT doc_id, locator, CASE yr WHEN 'Y' THEN y WHEN 'Z' THEN z END period_label, v value_raw, unit unit_raw, cast(v AS double) * factor gwh, metric, nullif(scope, '') measurement_scope FROM order_values JOIN {ph.values(ph.PAGE_FACTS, 'page', 'locator', 'yr', 'unit', 'factor', 'metric', 'scope')} c ON page = doc_id % {len(ph.FACT_PAGES)}",
    "row_texts": f"SELECT doc_id, replace(names, '{{N}}', n) names, replace(replace(replace(replace(text, '{{Y}}', y), '{{Z}}', z), '{{V}}', v), '{{N}}', n) text FROM order_values JOIN {ph.values(ph.ROW_TEXTS, 'names', 'text')} c ON k = doc_id % {len(ph.ROW_TEXTS)}",
    "row_facts": f"SELECT doc_id, nth, replace(station, '{{N}}', n) station, CASE yr WHEN 'Y' THEN y WHEN 'Z' THEN z ELSE yr END period_label, replace(val, '{{V}}', v) value_raw, unit unit_raw, cast(replace(val, '{{V}}', v) AS double) * factor gwh FROM order_values JOIN {ph.values(ph.ROW_FACTS, 'txt', 'nth', 'station', 'yr', 'val', 'unit', 'factor')} c ON txt = doc_id % {len(ph.ROW_TEXTS)}",
    "layout_pages": f"SELECT doc_id, page, replace(replace(replace(replace(text, '{{Y}}', y), '{{Z}}', z), '{{V}}', v), '{{N}}', n) text FROM order_values JOIN {ph.values(ph.LAYOUT_PAGES, 'txt', 'page', 'text')} c ON txt = doc_id % 6",
    "layout_found": f"SELECT doc_id, first_page, last_page, replace(replace(headers, '{{Y}}', y), '{{Z}}', z) headers, replace(replace(replace(cells, '{{Y}}', y), '{{V}}', v), '{{N}}', n) cells FROM order_values JOIN {ph.values(ph.LAYOUT_TABLES, 'txt', 'first_page', 'last_page', 'headers', 'cells')} c ON txt = doc_id % 6",
    "layout_notes": f"SELECT doc_id, previous_page, page, reasons FROM order_values JOIN {ph.values(ph.LAYOUT_NOTES, 'txt', 'previous_page', 'page', 'reasons')} c ON txt = doc_id % 6",
    "fetch_log": f"SELECT page_id, status, ctype, replace(replace(replace(replace(replace(body, '{{BIG}}', repeat('x', 300001)), '{{L}}', chr(10)), '{{C3}}', chr(3)), '{{C4}}', chr(4)), '{{B}}', html) body, expected, code, kind FROM pages JOIN {ph.values(ph.FETCHES, 'status', 'ctype', 'body', 'expected', 'code', 'kind')} c ON k = page_id % {len(ph.FETCHES)}",
    "probe_log": f"SELECT event_id, nullif(status, -1) status, ctype, document_type, 'https://x.example' || tail url, access, state FROM events JOIN {ph.values(ph.PROBES, 'status', 'ctype', 'document_type', 'tail', 'access', 'state')} c ON k = event_id % {len(ph.PROBES)}",
    "rated_sources": f"SELECT doc_id, 'Big Dam ' || n AS name, y AS year, r.url, r.source_type, r.score reliability, replace(replace(f.url, '{{Y}}', y), '{{S}}', lower(replace('Big Dam ' || n, ' ', ''))) fit_url, f.document_type, replace(replace(preview, '{{Y}}', y), '{{N}}', 'Big Dam ' || n) preview, f.score fit, g.url guess_url, g.document_type guess_type, channel, depth, g.score guess FROM order_values JOIN {ph.values(ph.RELIABILITY, 'url', 'source_type', 'score')} r ON r.k = doc_id % {len(ph.RELIABILITY)} JOIN {ph.values(ph.FITS, 'url', 'document_type', 'preview', 'score')} f ON f.k = doc_id % {len(ph.FITS)} JOIN {ph.values(ph.GUESSES, 'url', 'document_type', 'channel', 'depth', 'score')} g ON g.k = doc_id % {len(ph.GUESSES)}",
    "named": f"SELECT doc_id, names, known FROM order_values JOIN {ph.values(ph.ALIASES, 'names', 'known')} c ON k = doc_id % {len(ph.ALIASES)}",
    "phrased": f"SELECT doc_id, y AS year, name, standard, operator, country, domain AS site, fiscal, metric, replace(phrases, '{{Y}}', y) wanted, nullif(failure, '') failure, replace(tried, '{{Y}}', y) tried, replace(next_ones, '{{Y}}', y) next_ones FROM order_values JOIN {ph.values(ph.PHRASED, 'name', 'standard', 'operator', 'country', 'domain', 'fiscal', 'metric', 'phrases', 'failure', 'tried', 'next_ones')} c ON k = doc_id % {len(ph.PHRASED)}",
    "about": f"""SELECT *, replace(word, '{{Y}}', year) why, replace(proof, '{{T}}', text) shown FROM (SELECT doc_id, y AS year, 'Dam ' || n AS name, replace(replace(replace(replace(replace(text, '{{F}}', '{ph.FILLER.strip()}.'), '{{Y}}', y), '{{Z}}', z), '{{V}}', v), '{{N}}', 'Dam ' || n) text, CASE asked WHEN 'disclosure' THEN 'calendar_year' ELSE asked END period_type, asked = 'disclosure' disclosure, reason, score, scope,
        replace(word, '{{Z}}', z) word, replace(replace(replace(replace(proof, '{{Y}}', y), '{{Z}}', z), '{{V}}', v), '{{N}}', 'Dam ' || n) proof FROM order_values JOIN {ph.values(ph.RELEVANCES, 'text', 'asked', 'reason', 'score', 'scope', 'word', 'proof')} c ON k = doc_id % {len(ph.RELEVANCES)}) x""",
    "fact_sentences": f"SELECT doc_id, nth, replace(replace(replace(sentence, '{{Y}}', y), '{{Z}}', z), '{{V}}', v) snippet FROM order_values JOIN {ph.values(ph.SENTENCES, 'txt', 'nth', 'sentence')} c ON txt = doc_id % {len(ph.FACT_TEXTS)}",
    "answers": f"SELECT doc_id, replace(body, '{{V}}', v) body, valid, flags FROM order_values JOIN {ph.values(ph.ANSWERS, 'body', 'valid', 'flags')} c ON k = doc_id % {len(ph.ANSWERS)}",
    "locators": f"SELECT doc_id, locator, nullif(page, -1) page, nullif(table_ref, '') table_ref FROM order_values JOIN {ph.values(ph.LOCATORS, 'locator', 'page', 'table_ref')} c ON k = doc_id % {len(ph.LOCATORS)}",
    "raw_rows": """SELECT c_custkey, ' ' || c_name || ' ' AS name, CASE c_custkey % 7 WHEN 0 THEN 'Retired' WHEN 1 THEN 'mothballed' WHEN 2 THEN 'construction' WHEN 3 THEN '' ELSE ' Operating' END status, CASE WHEN c_custkey % 11 = 5 THEN 'n/a' ELSE cast(c_acctbal / 5 AS string) END capacity, n_name country,
        CASE WHEN c_custkey % 13 = 6 THEN '' ELSE 'U' || cast(c_custkey AS string) END unit, 'L' || cast(c_custkey % 100 AS string) AS location, cast(c_custkey % 200 - 98 AS string) latitude, cast(c_custkey % 380 - 185 AS string) longitude FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "known_entities": "SELECT entity_id, title a, nullif(source_type, 'other') status FROM sources UNION ALL SELECT entity_id, canonical_name, status FROM projects",
    "new_entities": "SELECT entity_id, canonical_name a, status FROM stations",
    "found_urls": """SELECT o_orderkey case_id, CASE WHEN o_orderkey % 3 = 0 THEN 'https://wrong.example/' || cast(o_orderkey AS string) ELSE 'HTTPS://H' || cast(o_custkey AS string) || '.example//r/?utm_source=a' END url FROM orders UNION ALL SELECT o_orderkey, 'https://h' || cast(o_custkey AS string) || '.example/r' FROM orders WHERE o_orderkey % 4 = 0""",
    "gold_urls": """SELECT o_orderkey case_id, CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed_no_hit' ELSE 'confirmed_hit' END label_status, CASE WHEN o_orderkey % 5 > 1 THEN 'https://h' || cast(o_custkey AS string) || '.example/r/' END url FROM orders""",
    "publisher_sources": """SELECT 'ps_' || cast(s_suppkey AS string) source_id, cast(s_suppkey % 40 AS string) entity_id, CASE WHEN s_suppkey % 4 = 1 THEN ' ' ELSE 'Publisher ' || s_name END publisher, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN 'en' ELSE 'pt' END language,
        'https://www.p' || cast(s_suppkey % 3 AS string) || '.example/r' || cast(s_suppkey % 5 AS string) || '/' || cast(2010 + s_suppkey % 9 AS string) || '.pdf' url, CASE WHEN s_suppkey % 6 = 5 THEN 'other' ELSE 'official' END source_type, s_acctbal / 8000 source_reliability_score, cast(s_suppkey % 5 AS int) success_count,
        cast('2024-01-' || lpad(cast(1 + s_suppkey % 28 AS string), 2, '0') || ' 00:00:00' AS timestamp) last_success FROM supplier""",
    "discoveries": """SELECT cast(o_custkey AS string) entity_id, 'https://d' || cast(o_orderkey % 4 AS string) || '.example/e' || cast(o_orderkey AS string) url, CASE WHEN o_orderkey % 5 = 0 THEN 'reference' ELSE 'official' END source_type, CASE o_orderkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'discovered' END status, o_orderdate updated_at FROM orders""",
    "homes": f"SELECT doc_id, country, url, text, nullif(why, '') why FROM order_values JOIN {ph.values(ph.HOMES, 'country', 'url', 'text', 'why')} c ON k = doc_id % {len(ph.HOMES)}",
    "linked_pages": """SELECT page_id, url, html || '<p><a href="/files/annual-report-' || cast(page_id % 40 AS string) || '.pdf">Report</a> <a href="/press/' || cast(page_id AS string) || '">News</a> <a href="/data.csv?v=2">t</a> <a href="https://other.example/' || cast(page_id % 3 AS string) || '.xlsx">x</a></p>' html FROM pages""",
    "station_sources": """SELECT 'ss_' || cast(c_custkey AS string) source_id, cast(cast(floor(c_custkey / 10) AS bigint) AS string) entity_id, 'https://s' || cast(c_custkey AS string) || '.example/' url, CASE WHEN c_custkey % 4 = 1 THEN 'net_generation' ELSE 'gross_generation' END covered_metric, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE cast(1992 + c_custkey % 7 AS int) END covered_year,
        cast(c_custkey % 5 AS double) / 5 source_reliability_score, cast(c_custkey % 4 AS int) success_count, cast(c_custkey % 6 AS int) failure_count, CASE WHEN c_custkey % 4 > 0 THEN cast('2023-' || CASE WHEN c_custkey % 7 < 4 THEN '12' ELSE '07' END || '-' || lpad(cast(1 + c_custkey % 28 AS string), 2, '0') || ' 00:00:00' AS timestamp) END last_success,
        CASE WHEN c_custkey % 6 > 0 THEN cast('2024-01-' || lpad(cast(1 + c_custkey % 28 AS string), 2, '0') || ' 00:00:00' AS timestamp) END last_failure FROM customer""",
    "source_tasks": "SELECT 'T' || cast(o_orderkey AS string) task_id, cast(cast(floor(o_custkey / 10) AS bigint) AS string) entity_id, CASE WHEN o_orderkey % 5 = 3 THEN 'net_generation' ELSE 'gross_generation' END metric, cast(year(o_orderdate) AS int) AS year FROM orders",
    "source_list": "SELECT source_id, min(title) title, min(url) url, CASE WHEN source_id LIKE '%3' THEN 'upload' ELSE 'http' END access_method FROM sources GROUP BY source_id",
    "asked_tasks": "SELECT task_id, 'generation' task_type, CASE WHEN task_id LIKE '%5' THEN 'https://user.example' WHEN task_id LIKE '%6' THEN '' END user_specified_source FROM tasks WHERE task_id NOT LIKE '%9'",
    "review_candidates": "SELECT candidate_id, CASE WHEN task_id LIKE '%8' THEN NULL ELSE task_id END task_id, entity_id, period_label, generation_gwh, document_id, snippet, CASE WHEN candidate_id LIKE '%7' THEN 'auto_search' ELSE 'rule' END extraction_method FROM candidates WHERE candidate_id NOT LIKE '%70'",
    "review_rows": """SELECT review_id, candidate_id, entity_id, status, reason, task_id, created_at, CASE WHEN review_id LIKE '%1' THEN '{"validation_issues":[{"code":"A","severity":"high"},{"code":"B","severity":"low"}],"candidate":{"flags":["OCR_DERIVED","X"]}}' WHEN review_id LIKE '%2' THEN 'not json' WHEN review_id LIKE '%3' THEN '{"candidate":{},"evidence_metadata":{"page":"3"}}' END payload FROM reviews""",
    "shown_evidence": "SELECT evidence_id, document_id, CASE WHEN evidence_id LIKE '%2' THEN NULL ELSE 'shown ' || evidence_id END snippet, CASE WHEN evidence_id LIKE '%3' THEN NULL ELSE page_number END page_number, CASE WHEN evidence_id LIKE '%1' THEN NULL ELSE 'T0' END task_id FROM evidence",
    "task_records": "SELECT id, candidate_id, CASE WHEN id % 2 = 0 THEN NULL ELSE 'T' || cast(id AS string) END task_id FROM records",
    "known_tasks": "SELECT task_id, entity_id, priority_tier, status, attempts, CASE WHEN task_id LIKE '%2' THEN 'manual' WHEN task_id LIKE '%3' THEN NULL ELSE 'auto' END source_type, CASE WHEN task_id LIKE '%2' THEN 'https://old.example' END user_specified_source FROM tasks",
    "created_tasks": """SELECT CASE WHEN task_id LIKE '%1' THEN 'N' ELSE '' END || task_id task_id, 'E' || entity_id entity_id, 'Z' priority_tier, 'pending' status, 0 attempts, CASE WHEN task_id LIKE '%24' OR task_id LIKE '%2' THEN 'manual' ELSE 'auto' END source_type, 'https://new.example' user_specified_source FROM tasks WHERE task_id NOT LIKE '%6'""",
    "lead_results": """SELECT page_id, 'T' || cast(page_id % 20 AS string) task_id, 'p' || cast(page_id % 2 AS string) provider, 'dam' AS query, CASE WHEN page_id % 9 = 8 THEN 'ftp://x' WHEN page_id % 3 = 0 THEN 'https://L' || cast(page_id % 30 AS string) || '.example/' ELSE ' https://l' || cast(page_id % 30 AS string) || '.example' END url, cast(1 + page_id % 5 AS int) AS rank, 'Title ' || cast(page_id AS string) title, 'About' snippet FROM pages""",
    "seed_rows": """SELECT trim(status) status, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'tech' || cast(c_custkey % 3 AS string) END technology, CASE WHEN c_custkey % 19 = 3 THEN '' ELSE country END country, CASE c_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'D' END priority_tier, location location_id, unit unit_id, CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE name END canonical_name,
        try_cast(capacity AS double) capacity_mw, try_cast(latitude AS double) latitude, try_cast(longitude AS double) longitude, c_custkey % 3 = 0 needs_review FROM raw_rows""",
    "eval_cases": """SELECT o_orderkey case_id, o_orderkey % 2 = 0 source_discovered, o_orderkey % 3 = 0 acquisition_success, o_orderkey % 5 <> 0 parse_success, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 4 = 0 END extraction_success, o_orderkey % 6 <> 1 entity_match, o_orderkey % 8 = 0 year_match, o_orderkey % 9 <> 2 unit_match, o_orderkey % 10 < 7 overall_pass,
        cast(o_orderkey % 21 AS double) / 20 value_accuracy, CASE o_orderkey % 10 WHEN 7 THEN 'extraction' WHEN 8 THEN 'parse' WHEN 9 THEN 'extraction' END error_stage FROM orders""",
    "named_stations": """SELECT cast(c_custkey AS string) entity_id, c_name canonical_name, CASE WHEN c_custkey % 3 = 0 THEN ' River  Dam ' || cast(c_custkey AS string) END local_name,
        CASE WHEN c_custkey % 4 = 1 THEN 'Old Mill ' || cast(c_custkey % 50 AS string) || '； M' || cast(c_custkey AS string) || '|K' ELSE '' END aliases FROM customer""",
    "asked_names": """SELECT o_orderkey ask_id, CASE o_orderkey % 8 WHEN 0 THEN upper(c_name) || ' ' WHEN 1 THEN 'river dam  ' || cast(o_custkey AS string) WHEN 2 THEN 'Old Mill ' || cast(o_custkey % 50 AS string) WHEN 3 THEN substr(c_name, 10) WHEN 4 THEN 'VER DAM ' || cast(o_custkey AS string)
        WHEN 5 THEN 'm' || cast(o_custkey AS string) WHEN 6 THEN '#00' ELSE 'nowhere ' || cast(o_custkey AS string) END AS name FROM orders JOIN customer ON c_custkey = o_custkey""",
    "mentions": """SELECT l_orderkey document_id, l_linenumber nth, l_partkey part, CASE WHEN l_orderkey % 5 = 0 THEN 'ab' ELSE 'Big-Dam ' || cast(l_orderkey % 50 AS string) || '|大坝' END names, CASE WHEN l_orderkey % 4 = 0 OR l_linenumber % 3 = 1 THEN 'Other plant' WHEN l_linenumber % 3 = 2 THEN 'the BIG DAM (' || cast(l_orderkey % 50 AS string) || ')' END snippet,
        CASE WHEN l_linenumber = 5 THEN NULL WHEN l_linenumber < 4 THEN 5.0e0 ELSE cast(l_quantity AS double) END generation_gwh, CASE WHEN l_linenumber % 2 = 0 THEN 'GWH' ELSE 'GWh' END unit_raw, CASE l_linenumber % 4 WHEN 2 THEN NULL WHEN 3 THEN '' ELSE '2020' END period_label FROM lineitem""",
    "gold_cases": """SELECT o_orderkey case_id, c_name || CASE WHEN o_orderkey % 3 = 0 THEN ' Hydroelectric-Station' ELSE ' of Avon' END canonical_name, cast(year(o_orderdate) AS int) AS year, 'https://s' || cast(o_custkey AS string) || '.example' || CASE o_orderkey % 5 WHEN 0 THEN '/' WHEN 1 THEN '/en/' WHEN 2 THEN '/en/report' ELSE '/r.pdf?x=/' END source_url FROM orders JOIN customer ON c_custkey = o_custkey""",
    "gold_probes": """SELECT o_orderkey case_id, CASE o_orderkey % 7 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'requires_browser' ELSE 'reachable' END access, CASE WHEN o_orderkey % 11 = 3 THEN 'https://moved.example/ZH' ELSE '' END final_url,
        CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'GENERATED in ' || cast(year(o_orderdate) AS string) || ' by Avon' WHEN 2 THEN '发电量 ' || cast(year(o_orderdate) AS string) || ' station' ELSE 'avon, generation of 1901' END preview FROM orders WHERE o_orderkey % 13 <> 2""",
    "found_sources": """SELECT page_id id, cast(page_id % 7 AS int) AS rank, 'https://h' || cast(page_id % 23 AS string) || '.example/r' home, CASE page_id % 3 WHEN 0 THEN 'https://h' || cast(page_id % 23 AS string) || '.example/r' WHEN 1 THEN 'HTTPS://H' || cast(page_id % 23 AS string) || '.example//r/' ELSE 'https://h' || cast(page_id % 23 AS string) || '.example/r?utm_source=a' END url,
        CASE WHEN page_id % 5 = 0 THEN 'https://f' || cast(page_id % 400 AS string) || '.example/doc' ELSE '' END final_url, CASE WHEN page_id % 13 = 4 THEN 'https://c' || cast(page_id % 3 AS string) || '.example/x' END canonical_url,
        CASE WHEN page_id % 6 = 1 THEN cast(page_id % 11 AS double) / 8 END combined_score, CASE WHEN page_id % 6 = 2 THEN 0.5e0 END estimated_reliability, CASE page_id % 5 WHEN 0 THEN 'official' WHEN 1 THEN 'authority' WHEN 2 THEN '' WHEN 3 THEN 'reference' ELSE 'unknown' END source_type,
        CASE page_id % 3 WHEN 0 THEN 'program_search_result' WHEN 1 THEN 'official_site_explorer' END discovery_method, CASE WHEN page_id % 4 = 1 THEN 'reason ' || cast(page_id AS string) END match_reason, CASE WHEN page_id % 2 = 0 THEN 'Title ' || cast(page_id AS string) ELSE '' END title FROM pages""",
    "candidate_urls": """SELECT page_id, url, page_id % 7 rank_no, cast(page_id % 11 AS double) / 10 score, CASE page_id % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'authority' ELSE 'other' END source_type FROM pages
        UNION ALL SELECT page_id + 1000000, upper(substr(url, 1, 7)) || substr(url, 8) || '#x', 3, cast(page_id % 5 AS double) / 5, 'search' FROM pages WHERE page_id % 2 = 0""",
}

#: An order's evidence of line 1, as `candidates` looks it up, and the same by the order's key: the id is made of both keys, so no other evidence has it.
_BY_ID = "LEFT JOIN (SELECT evidence_id, document_id FROM evidence) e ON e.evidence_id = 'E' || cast(o_orderkey AS string) || '-1'"
_BY_KEY = "LEFT JOIN (SELECT l_orderkey, 'doc_' || cast(min(l_suppkey) AS string) document_id FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey) e ON l_orderkey = o_orderkey"

#: The same rows as Spark makes them: grouped by the numbers that ids are made of, so that nothing is sorted for columns that nobody asks for, and a join that gives no column asked for is left out.
#: The first row of an evidence has the least l_suppkey, nulls last as in DuckDB; rows that its ORDER BY leaves equal are told apart by l_shipdate.
SPARK_FRAMES: dict[str, str] = {
    "candidates": FRAMES["candidates"].replace(_BY_ID, _BY_KEY),
    "candidate_evidence": """SELECT 'C' || cast(l_orderkey AS string) candidate_id, 'E' || cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) evidence_id
        FROM (SELECT DISTINCT l_orderkey, CASE WHEN l_orderkey IS NOT NULL THEN l_linenumber END l_linenumber FROM lineitem WHERE l_linenumber % 7 <> 0) x""",
    "evidence": """SELECT 'E' || cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) evidence_id, 'doc_' || cast(supplier AS string) document_id,
        CASE WHEN supplier % 11 = 0 THEN 'stale' ELSE 'h' || cast(supplier AS string) END content_hash, 'generation' fact_type, cast(l_linenumber AS int) page_number, shipped created_at FROM (
        SELECT l_orderkey, l_linenumber, min(l_suppkey) supplier, min_by(l_shipdate, struct(l_suppkey IS NULL, l_suppkey, l_partkey IS NULL, l_partkey, l_extendedprice IS NULL, l_extendedprice, l_shipdate IS NULL, l_shipdate)) shipped
        FROM lineitem GROUP BY l_orderkey, l_linenumber) x""",
}

_NEEDS = {name: [b for b in (*BASE, *FRAMES) if b != name and f" {b}" in f" {sql} ".replace("\n", " ").replace("(", " ").replace(",", " ") and any(w == b for w in sql.replace("(", " ").replace(")", " ").replace(",", " ").split())] for name, sql in FRAMES.items()}


def _closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for x in [*_closure(tuple(_NEEDS.get(name, ()))), name]:
            if x not in out:
                out.append(x)
    return out


def with_(*names: str) -> str:
    """A WITH clause that defines the frames for DuckDB, where the base tables are views."""
    own = [x for x in _closure(names) if x in FRAMES]
    return "WITH " + ",\n".join(f"{x} AS ({FRAMES[x]})" for x in own) + "\n"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or domain frame as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = _closure((name,))
    parts = [f"{x} AS (SELECT * FROM parquet.`{sf_dir}/{x}.parquet`)" if x in BASE else f"{x} AS ({SPARK_FRAMES.get(x, FRAMES[x])})" for x in needs]
    return spark.sql("WITH " + ",\n".join(parts) + f"\nSELECT * FROM {name}")

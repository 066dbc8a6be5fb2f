"""Single rules on literal rows, and invariants of frame operators."""

import pytest
from pyspark.sql import functions as F

from wattline.functions import text as tx
from wattline.operators import extract as ex, frames as fr
from wattline.streaming import jobs


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("1,234.5", 1234.5), ("1.234,5", 1234.5), ("83,5", 83.5), ("83,500", 83500.0), ("1.234.567", 1234567.0), ("12", 12.0), ("x", None)])
def test_parse_number(spark, raw, want):
    assert one(spark, tx.parse_number(F.col("v")), v=raw) == want


def test_local_thousands(spark):
    assert one(spark, tx.parse_number(F.col("v"), F.lit(True)), v="83.879") == 83879.0


@pytest.mark.parametrize(("unit", "kind", "factor"), [("TWh", "energy", 1000.0), ("亿千瓦时", "energy", 100.0), ("万千瓦时", "energy", 0.01), ("MW", "power", None), ("万千瓦", "power", None), ("兆瓦时", "energy", 0.001), ("wh", "unclear", None), ("?", "unclear", None)])
def test_units(spark, unit, kind, factor):
    assert one(spark, tx.unit_kind(F.col("v")), v=unit) == kind
    assert one(spark, tx.unit_factor(F.col("v")), v=unit) == factor


@pytest.mark.parametrize(("raw", "want"), [("20", 20), ("32 x 700 MW; 2 x 50 MW", 34), ("many", None)])
def test_turbines(spark, raw, want):
    assert one(spark, tx.turbines(F.col("v")), v=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("HTTPS://Ex.org:443//a//b/?utm_source=x&q=1#f", "https://ex.org/a/b?q=1"), ("http://ex.org/", "http://ex.org/"), ("plain/", "plain"), ("ftp://Ex.org/A/", "ftp://Ex.org/A"), ("http://u:p@EX.org:80?mc_cid=1&spm=2", "http://ex.org/?spm=2")])
def test_canonical_url(spark, raw, want):
    assert one(spark, tx.canonical_url(F.col("v")), v=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("FY 2020 report", "fiscal_year"), ("2020年一季度", "quarter"), ("rolling 12 months to Q1", "rolling_12_months"), ("2021/2022", "fiscal_year"), ("in May", "month"), ("全年", "calendar_year")])
def test_period(spark, raw, want):
    assert one(spark, tx.period_type(F.col("v")), v=raw) == want


def test_years(spark):
    assert one(spark, tx.find_years(F.col("v")), v="2020年, 2019; 2020 and 120199") == ["2020", "2019"]


def test_ids_keep_empty_parts(spark):
    a = one(spark, tx.short_id("x_", F.col("a"), F.col("b")), a="p", b=None)
    assert a != one(spark, tx.short_id("x_", F.col("a")), a="p")


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    once = fr.upsert(old, new, ["id"])
    assert sorted(once.collect()) == sorted(fr.upsert(once, new, ["id"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_spans_of_cells(spark):
    html = "<table><tr><th colspan=2>h</th></tr><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table><script>x</script>t<a href='/q'>l</a>"
    row = ex.parse_pages(spark.createDataFrame([(html,), (None,)], "html string")).collect()
    assert [(t.headers, t.rows, t.caption) for t in row[0].parsed.tables] == [(["h", "h"], [["a", "b"], ["a", "c"]], None)]
    assert row[0].parsed.links == ["/q"] and "x" not in row[0].parsed.text
    assert row[1].parsed.ok is False


def test_record_confidence(spark):
    high = [("UNIT_UNCLEAR", "high")]
    rows = [(1, [], True, 0.9, True, True), (2, [], True, 0.9, None, None), (3, high * 3, False, 0.2, True, False), (4, high, False, None, True, True), (5, high * 3, False, 0.8, None, None), (6, [], True, 1.2, True, True)]
    frame = spark.createDataFrame(rows, "id int, issues array<struct<code:string,severity:string>>, passed boolean, confidence double, has_evidence boolean, has_page boolean")
    got = {r.id: r.x for r in frame.select("id", ex.record_confidence().alias("x")).collect()}
    assert got == {1: 0.925, 2: 0.85, 3: 0.0, 4: 0.475, 5: 0.25, 6: 1.0}


def test_document_links(spark):
    from urllib.parse import urljoin, urlparse

    hrefs = ["/annual-report.pdf", "/annual-reports.pdf", "/the", "/about", "mailto:report@x.example", "data.csv?v=2", "/a/b", "/annual-report.pdf", "#top", "?report=1", "https://other.example/x.XLSX", "//cdn.example/statement", "javascript:report()", "/news/2019", "/report-1999", "/report-2020"]
    marks = ["", "", "", "<b>Annual</b> figures", "", "", "", "again", "report", "", "", "", "", "2019", "", ""]
    more = [f"/report-{i}/" for i in range(9)]
    url = "https://www.x.example/en/list/index.html?p=1#q"
    pages = [(1, url, "".join(f"<p><a href='{h}'>{t}</a> report 2019" for h, t in zip(hrefs, marks, strict=True))), (2, "http://y.example", "".join(f"<a href='{h}'>x</a>" for h in more)), (3, url, None), (4, None, "<a href='/report.pdf'>a</a><a href='http://z.example/report.pdf'>b</a>")]
    parsed = ex.parse_pages(spark.createDataFrame(pages, "page_id int, url string, html string"))
    terms, ends = ex.DOCUMENT_TERM.split("|"), (".pdf", ".xlsx", ".xls", ".csv", ".json", ".xml")

    def wanted(page, base, links, texts, year, most):
        seen, out = {base.rstrip("/").lower()}, []
        for at, (h, t) in enumerate(zip(links, texts, strict=True)):
            full = urljoin(base, h)
            corpus = f"{full} {t}".lower()
            suffix, term = urlparse(full).path.lower().endswith(ends), any(x in corpus for x in terms)
            dated = year is None or any(str(y) in corpus for y in (year - 1, year, year + 1)) or suffix and term
            if full.startswith("http") and (suffix or term) and dated and (key := full.rstrip("/").lower()) not in seen:
                seen.add(key)
                out.append((page, at, h))
        return out[:most]

    for year, most in ((None, 8), (None, 99), (2019, 99)):
        got = sorted(map(tuple, ex.document_links(parsed, year=year, most=most).drop("full").collect()))
        want = wanted(1, url, hrefs, [t.replace("<b>", "").replace("</b>", "") for t in marks], year, most) + wanted(2, "http://y.example", more, ["x"] * 9, year, most)
        assert got == want + [(4, 1, "http://z.example/report.pdf")]
    data = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html")
    real = ex.parse_pages(pages).collect()
    want = [x for r in real for x in wanted(r.page_id, r.url, r.parsed.links, r.parsed.link_texts, None, 8)]
    assert sorted(map(tuple, ex.document_links(ex.parse_pages(pages)).drop("full").collect())) == sorted(want)


def test_quota(spark):
    """A brute-force walk over each key's calls: budget of a request, failures in a row, admitted calls in the window."""
    calls = jobs.provider_calls(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    for limit, seconds, budget, failures in ((2, 36_000, 99, 99), (3, 3600, 2, 1), (50, 60, 3, 2)):
        got = {r.event_id: r.status for r in jobs.quota_admit(calls, limit, seconds, budget, failures).collect()}
        done: dict = {}
        for r in sorted(calls.collect(), key=lambda r: (r.ts, r.event_id)):
            own = done.setdefault(r.key, [])
            request = []
            for q in reversed(own):
                if q.request != r.request:
                    break
                request.insert(0, q)
            taken = [q for q in request if got[q.event_id] == "admitted"]
            row = 0
            for q in reversed(taken):
                if not q.failed:
                    break
                row += 1
            near = [q for q in own if got[q.event_id] == "admitted" and (r.ts - q.ts).total_seconds() < seconds]
            want = "budget_exhausted" if len(taken) >= budget else "circuit_open" if row >= failures else "rate_limited" if len(near) >= limit else "admitted"
            assert got[r.event_id] == want
            own.append(r)


def test_ranks_of_parts(spark):
    from wattline.operators import trust as t

    rows = spark.range(2000).select("id", (F.col("id") % 3).alias("entity_id"), (F.col("id") % 2).alias("y"), (F.col("id") % 97).cast("double").alias("generation_gwh"))
    assert sorted(t.rank_by(rows, "y", part_rows=90).collect()) == sorted(t.rank_by(rows, "y").collect())


def test_leases(spark, tmp_path):
    """Only the holder's heartbeat extends a lease; a claim after the end takes the task again; the stream finds what the batch finds."""
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, "claim", 7, at(0)), (1, "heartbeat", 7, at(30)), (2, "claim", 7, at(0)), (2, "heartbeat", 8, at(50)), (3, "claim", 7, at(0)), (3, "done", 7, at(5)), (4, "claim", 7, at(0)), (4, "done", 7, at(9)), (4, "claim", 9, at(20)), (5, "heartbeat", 1, at(1)), (6, "claim", 1, at(900))]
    events = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "task_id long, kind string, worker long, ts timestamp, event_id long")
    want = {1: (at(30), 1), 2: (at(0), 1), 4: (at(20), 2)}
    batch = jobs.lease_expiry(events, "2024-01-01 15:01:00", 3600).collect()
    assert {r.task_id: (r.last_seen, r.attempts) for r in batch} == want
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    later = spark.createDataFrame([(9, "heartbeat", 0, at(2000), 99)], events.schema)
    run = jobs.lease_expiry(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "", 3600).writeStream.format("memory").queryName("leases").outputMode("append").start()
    run.processAllAvailable()
    later.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run.processAllAvailable()
    later.withColumn("ts", F.col("ts") + F.expr("interval 1 day")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run.processAllAvailable()
    run.stop()
    got = {r.task_id: (r.last_seen, r.attempts) for r in spark.table("leases").collect()}
    assert got == want | {6: (at(900), 1)}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = jobs.idempotent_ingest(stream).writeStream.format("memory").queryName("ingest").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(str, spark.table("ingest").collect())) == sorted(map(str, jobs.idempotent_ingest(events).collect()))


def test_quota_in_event_time(spark, tmp_path):
    """Calls that micro-batches deal out in any order are judged as in a batch; what is later than the delay is not."""
    calls = jobs.provider_calls(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).where("key < 6")
    want = {r.event_id: r.status for r in jobs.quota_admit(calls, 2, 360_000, 1, 1).collect()}
    for i in range(4):
        calls.where(F.pmod(F.hash("event_id"), F.lit(4)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = jobs.quota_admit(stream, 2, 360_000, 1, 1, delay="500 days").writeStream.format("memory").queryName("quota").outputMode("append").start()
    run.processAllAvailable()
    assert spark.table("quota").count() == 0
    end = calls.limit(1).select("key", "request", F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("interval 2000 days")).alias("ts"), "failed")
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run.processAllAvailable()
    late = calls.limit(1).withColumn("event_id", F.lit(-2).cast("long"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run.processAllAvailable()
    run.stop()
    got = spark.table("quota").collect()
    assert len(got) == len(want) and {r.event_id: r.status for r in got} == want and len(set(want.values())) > 2


def test_archive_sink(spark, tmp_path):
    """Deliveries of a stream, one of them twice, give the versions of the whole history; new content of a known address comes after its last."""
    import datetime as dt

    from wattline.operators import archive as ar

    day = lambda d: dt.datetime(2024, 1, d)
    batches = [[("u", "a", day(1)), ("v", "a", day(1)), ("u", "a", day(1))], [("u", "b", day(3)), ("u", "a", day(4)), ("u", "c", day(2)), (None, "x", day(1))], [("u", "d", day(1)), ("v", None, day(9))]]
    kind = "url string, content_hash string, fetched_at timestamp"
    at = str(tmp_path / "archive")
    sink = ar.archive_sink(spark, at)
    for i, rows in enumerate([*batches[:2], batches[1], batches[2], batches[0]]):
        sink(spark.createDataFrame(rows, kind), i)
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in")).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).start()
    stream.processAllAvailable()
    stream.stop()
    got = sorted((r.url, r.version, r.content_hash) for r in spark.read.parquet(at).collect())
    assert got == [("u", 1, "a"), ("u", 2, "c"), ("u", 3, "b"), ("u", 4, "d"), ("v", 1, "a")]
    assert len({r.document_id for r in spark.read.parquet(at).collect()}) == 5


def test_json_as_python_writes_it(spark):
    import json

    from wattline.operators import archive as ar

    numbers = [0.0, -0.0, 1.0, -2.5, 1e7, 123456789.125, 1e15, 1.5e16, 1e22, 1.25e-5, 0.001, 0.0001, 9.9e-5, -3e-9, 1e100, 0.1 + 0.2]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", ar.json_number(F.col("x")).alias("s")).collect()
    assert {r.x: r.s for r in rows} == {x: json.dumps(x) for x in numbers}
    texts = ['a "b" \\ c', "line\nend\ttab\r", "\x01\x12\x7f é 中 \b\f", ""]
    row = spark.createDataFrame([(t, None, 2, 1.5, ["y", 'x"']) for t in texts], "t string, n string, k int, d double, l array<string>")
    for keep, tight in ((False, False), (True, True)):
        got = row.select("t", ar.canonical_json({c: ar.json_cell(row, c, tight) for c in row.columns}, keep, tight).alias("j")).collect()
        for r in got:
            want = {"t": r.t, "k": 2, "d": 1.5, "l": ["y", 'x"']} | ({"n": None} if keep else {})
            assert r.j == json.dumps(want, sort_keys=True, ensure_ascii=False, separators=(",", ":") if tight else None)


def test_approval_hash_of_a_typed_case(spark):
    import hashlib
    import json

    from wattline.operators import archive as ar

    one = {"entity_id": "7", "generation_gwh": 12345678.5, "metric": "gross_generation", "snippet": 'say "12" é', "document_id": "d1"}
    c = spark.createDataFrame([("c1", *one.values(), None), ("c2", *one.values(), None)], "candidate_id string, entity_id string, generation_gwh double, metric string, snippet string, document_id string, locator string")
    links = spark.createDataFrame([("c1", "e2"), ("c1", "e1"), ("c1", "e2")], "candidate_id string, evidence_id string")
    evidence = spark.createDataFrame([("e1", "d2", "h1"), ("e2", "d1", "h2")], "evidence_id string, document_id string, content_hash string")
    versions = [{"evidence_id": "e1", "document_id": "d2", "content_hash": "h1"}, {"evidence_id": "e2", "document_id": "d1", "content_hash": "h2"}]
    digest = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    got = {r.candidate_id: r.candidate_hash for r in ar.candidate_hash(c, links, evidence).collect()}
    assert got == {"c1": digest(one | {"evidence_ids": ["e1", "e2"], "evidence_versions": versions}), "c2": digest(one)}


def test_export_forms(spark, tmp_path):
    import csv
    import json

    from wattline.operators import archive as ar

    rows = [(1, "5", 'Big, "Dam"', None, 100.0, "1998", 12.5, "gwh", 0.9, "s1"), (2, "6", "A|B", "BR", None, "1998", 7.0, "gwh", None, "s2")]
    ranking = spark.createDataFrame(rows, "rank int, entity_id string, canonical_name string, country string, capacity_mw double, year string, generation_gwh double, unit string, confidence_score double, source_id string")
    stats = spark.createDataFrame([(9, 8, 7, 1.25, 0.5)], "total_records long, total_stations long, total_countries long, total_generation_twh double, avg_generation_gwh double")
    text = {}
    for form in ("json", "csv", "markdown"):
        ar.export_ranking(ar.ranking_document(ranking, stats, 1998, 2, form), str(tmp_path / form))
        files = list((tmp_path / form).glob("part-*"))
        assert len(files) == 1
        text[form] = files[0].read_text()
    whole = json.loads(text["json"])
    assert whole["count"] == 2 and whole["statistics"]["total_records"] == 9 and whole["ranking"][0]["canonical_name"] == 'Big, "Dam"' and whole["ranking"][0]["country"] is None
    read = list(csv.DictReader(text["csv"].splitlines()))
    assert [r["canonical_name"] for r in read] == ['Big, "Dam"', "A|B"] and read[1]["capacity_mw"] == ""
    lines = text["markdown"].splitlines()
    assert lines[0].endswith("Top 2 (1998)") and "- **总发电量**: 1.25 TWh" in lines and lines[-1] == "| 2 | A\\|B | BR | N/A | 7.00 | 0.00 |" and lines[-2] == '| 1 | Big, "Dam" | N/A | 100 | 12.50 | 0.90 |'


def test_merged_sources_of_a_hot_address(spark):
    """One address with many rows, over many partitions, by a walk in order; aliases are the first twenty."""
    from wattline.operators import merging as me

    import random

    g = random.Random(3)
    rows = []
    for i in range(3000):
        rows.append((g.randrange(5), i, f"https://h{0 if i % 3 else i % 7}.example/r{'/' * (i % 2)}", f"https://f{g.randrange(60)}.example/", g.choice([None, 0.1, 0.5, 1.7]), g.choice(["official", "", None, "reference"]), g.choice(["program_search_result", None]), g.choice(["", "why"]), f"t{i}" if i % 4 else None))
    df = spark.createDataFrame(rows, "rank int, id int, url string, final_url string, priority_score double, source_type string, discovery_method string, match_reason string, title string").repartition(7)
    want = {}
    for rank, i, url, final, score, kind, method, why, title in sorted(rows):
        key = url.rstrip("/")
        score = None if score is None else min(1.0, score)
        quality = (score is not None, score or 0.0, me.KINDS.get(kind or "", 0), me.METHODS.get(method or "", 0), bool(why))
        own = want.setdefault(key, {"url": url, "q": None, "aliases": [], "rows": 0, "score": None, "source_type": None, "discovery_method": None, "match_reason": None, "title": None})
        own["rows"] += 1
        if final not in own["aliases"]:
            own["aliases"].append(final)
        if own["q"] is None or quality > own["q"]:
            own["q"] = quality
            own |= {k: v for k, v in (("score", score), ("source_type", kind), ("discovery_method", method), ("match_reason", why), ("title", title)) if v not in (None, "")}
    got = {r.canonical: r for r in me.merge_sources(df).collect()}
    assert got.keys() == want.keys()
    for key, own in want.items():
        r = got[key]
        assert (r.url, r.rows, r.score, r.source_type, r.discovery_method, r.match_reason, r.title, r.alias_urls) == (own["url"], own["rows"], own["score"], own["source_type"], own["discovery_method"], own["match_reason"], own["title"], own["aliases"][:20])
    final = me.merge_sources(df, prefer_final=True).collect()
    assert len(final) == 60 and all(u != r.canonical for r in final for u in r.alias_urls) and any(r.alias_urls for r in final)

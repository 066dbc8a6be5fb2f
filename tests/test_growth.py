"""Queries whose work or shuffles grew too fast: what they shuffle, and how often they do the same work."""

import pytest
from pyspark.sql import functions as F

from wattline.operators import desk as dk, extract as ex, facts as fa, layout as la, relevance as rl, search_phrases as sp, trust as t
from wattline.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning")


def test_layout_pages_are_shuffled_once(spark):
    """Lines of pages are not shuffled: tables are found where a page is read, and one shuffle by document tells what goes on."""
    pages = spark.createDataFrame([(1, 1, "Station  Annual GWh\nA  1"), (1, 2, "B  2"), (1, 3, "Quarter Q2\nC  3")], "doc int, page int, text string").repartition(3)
    tables, notes = la.page_tables(pages, "doc", "page", "text")
    assert shuffles(la.layout_tables(pages, "doc", "page", "text")) == 0
    assert shuffles(tables) == shuffles(notes) == 1
    assert [tuple(r) for r in tables.collect()] == [(1, 1, 2, ["Station", "Annual GWh"], [["A", "1"], ["B", "2"]])]
    assert [tuple(r) for r in notes.collect()] == [(1, None, 3, ["period_changed"])]


@pytest.mark.parametrize(("text", "rows"), [
    ("　Station  GWh A\t1\r\nB  b  2,5", [["A", "1", ""], ["B", "b", "2,5"]]),  # Unicode's blanks and line ends
    ("Station\x1f\x1fGWh\nA  1", []),  # no blank in Unicode
    ("Station  GWh\nA  ١", []),  # digits are those of ASCII
    ("Station  GWh\n\nA  1", []),
    (None, []),
])
def test_layout_odd_pages(spark, text, rows):
    pages = spark.createDataFrame([(1, 1, text)], "doc int, page int, text string")
    assert [r.rows for r in la.layout_tables(pages, "doc", "page", "text").collect()] == ([rows] if rows else [])


def test_layout_runs(spark):
    """The longest run with the header's width, the first of equal ones; a gap ends the chain."""
    pages = [(1, 1, "Station  GWh\nA  1"), (1, 2, "B  2\nx\nC  3"), (1, 3, "D  d  4"), (1, 4, "E  5"), (2, 1, "Year  GWh\n1999  1"), (2, 3, "F  6"), (3, 1, "G  7")]
    tables, notes = la.page_tables(spark.createDataFrame(pages, "doc int, page int, text string"), "doc", "page", "text")
    assert sorted((r.doc, r.first_page, r.last_page, r.rows) for r in tables.collect()) == [(1, 1, 2, [["A", "1"], ["B", "2"]]), (2, 1, 1, [["1999", "1"]])]
    assert notes.count() == 0


def test_pages_are_parsed_once(spark):
    """Facts of text, tables and station rows come from one pass: a page is parsed once, and searched once."""
    html = "<p>In 2020 net generation 5 GWh</p><table><tr><th>Plant</th><th>2019 generation GWh</th></tr><tr><td>A dam</td><td>7</td></tr></table>"
    pages = spark.createDataFrame([(1, ["A dam"], html), (2, None, None)], "doc_id int, names array<string>, html string")
    parsed = ex.parse_pages(pages)
    tables, everything = fa.extract_tables(parsed, "doc_id", "names"), fa.extract_all(parsed, "doc_id", "names")
    assert plan(tables).count("MapInArrow") == plan(everything).count("MapInArrow") == 2
    assert ("table[0].row[0].col[1]", "2019", "7", "GWh") in {(r.locator, r.period_label, r.value_raw, r.unit_raw) for r in tables.collect()}
    assert ("text", "2020", "5", "GWh") in {(r.locator, r.period_label, r.value_raw, r.unit_raw) for r in everything.collect()}
    assert tables.count() == fa.extract_tables(parsed, "doc_id").count()


def test_rows_are_ranked_from_one_table(spark):
    """What is ranked is made once, not again for counts, cuts and numbers."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(1000).selectExpr("id", "cast(id as string) entity_id", "'y' y", "cast(id % 7 as double) generation_gwh").repartition(4)
    out = t.rank_by(rows.mapInArrow(run, rows.schema), "y", part_rows=300).collect()
    assert sorted(r["rank"] for r in out) == list(range(1, 1001))
    assert seen.value == 1000


def test_review_detail_shuffles(spark):
    """What documents say of evidence is joined last, and an evidence is gathered once."""
    make = spark.createDataFrame
    reviews = make([("r1", "c1", "open", None, None), ("r2", "c2", "open", None, None)], "review_id string, candidate_id string, status string, reason string, payload string")
    candidates = make([("c1", "s1", "own"), ("c2", "s1", "own")], "candidate_id string, entity_id string, snippet string")
    links = make([("c1", "e2"), ("c1", "e1")], "candidate_id string, evidence_id string")
    evidence = make([("e1", "d1", None, 4), ("e2", "d2", "two", 5)], "evidence_id string, document_id string, snippet string, page_number int")
    documents = make([("d1", "q", "pdf")], "document_id string, source_id string, content_kind string")
    sources = make([("q", "Title", "u")], "source_id string, title string, url string")
    stations = make([("s1", "S", "X", 1.0)], "entity_id string, canonical_name string, country string, capacity_mw double")
    out = dk.review_detail(reviews, candidates, links, evidence, documents, sources, stations)
    assert "min_by" not in plan(out)
    got = {r.review_id: r for r in out.collect()}
    assert [e.evidence_id for e in got["r1"].evidences] == ["e1", "e2"] and got["r1"].evidences[1].source_title is None
    assert (got["r1"].snippet, got["r1"].page_number, got["r1"].source_title, got["r1"].content_kind) == ("own", 4, "Title", "pdf")
    assert (got["r2"].snippet, got["r2"].page_number, got["r2"].evidences) == ("own", None, [])


def test_phrases_are_made_once(spark):
    """Phrases are not made again for each phrase they are compared with; braces in a name stay."""
    row = spark.createDataFrame([("A {Y}", "Op", "Peru", "2020")], "name string, operator string, country string, year string")
    none = F.lit(None).cast("array<string>")
    column = sp.query_variants(F.col("name"), F.col("operator"), F.col("country"), F.col("year"), none, F.lit(False))
    out = row.select(column.alias("q"))
    assert [x["query"] for x in out.first().q] == ['"A {Y}" 2020 annual generation', '"A {Y}" 2020 annual report generation', '"Op" 2020 annual report "A {Y}" generation']
    assert out._jdf.queryExecution().optimizedPlan().toString().count("operator_annual_disclosure") < 40


def test_scores_shuffle_no_issues(spark):
    """Lines of orders are not sorted, nor joined to candidates for a document that nobody asks for; what is shuffled is a number, not the issues."""
    made = plan(catalog.QUERIES["score_record"](spark, "/root/testdata/sf0.001"))
    assert "Window" not in made and "issues#" not in made and made.count("l_orderkey#") > 0
    assert "l_suppkey#" not in made


def test_rule_scores(spark):
    """The number is that of the issues."""
    schema = "candidate_id int, entity_id string, task_id string, period_type string, period_label string, value_type string, measurement_scope string, metric string, normalized_unit string, generation_gwh double, confidence double, flags array<string>"
    good = {"candidate_id": 0, "entity_id": "s", "task_id": "t", "period_type": "calendar_year", "period_label": "2020", "value_type": "actual", "measurement_scope": "plant", "metric": "gross_generation", "normalized_unit": "gwh", "generation_gwh": 1.0, "confidence": 0.9, "flags": ["OCR_DERIVED"]}
    odd = [{}, {"confidence": 0.5}, {"confidence": None}, {"flags": None}, {"flags": ["X", None, "CAPACITY_SUSPECT"]}, {"flags": ["UNIT_UNCLEAR", "PERIOD_UNCLEAR"]}, {"period_label": "20201"}, {"period_label": "2019, 2020, 2019"}, {"period_label": "2019-2021", "task_id": None}, {"period_label": "FY2019"}, {"period_label": None, "value_type": None, "metric": None},
           {"normalized_unit": None, "metric": "net_generation", "value_type": "forecast"}, {"entity_id": None, "generation_gwh": -1.0}, {"generation_gwh": 1e9}, {"period_type": "fiscal_year"}, {"period_type": None, "task_id": "f"}, {"entity_id": "known", "value_type": None}, {k: None for k in good}]
    rows = [tuple((good | x | {"candidate_id": i}).values()) for i, x in enumerate(odd)]
    stations = spark.createDataFrame([("s", 1.0), ("known", None)], "entity_id string, capacity_mw double")
    tasks = spark.createDataFrame([("t", "2020", "calendar_year"), ("f", "2020", "fiscal_year")], "task_id string, target_period string, task_period_type string")
    there = spark.createDataFrame([("known", "2020", None, "plant")] * 2, "entity_id string, period_label string, value_type string, measurement_scope string")
    asked = (spark.createDataFrame(rows, schema), stations, tasks, there)
    none = {k: F.lit(None).cast("boolean") for k in ("has_evidence", "has_page")}
    want = ex.validate_candidates(*asked).withColumns(none)
    got = {r.candidate_id: r.x for r in ex.rule_scores(*asked).withColumns(none).select("candidate_id", ex.record_confidence(F.col("rule_score")).alias("x")).collect()}
    assert got == {r.candidate_id: r.x for r in want.select("candidate_id", ex.record_confidence().alias("x")).collect()}
    codes = {r.candidate_id: [f"{i.code}:{i.severity}:{i.field}" for i in r.issues] for r in want.collect()}
    assert codes[0] == codes[3] == codes[6] == codes[7] == [] and codes[1] == ["LOW_CONFIDENCE:medium:confidence"] and codes[8] == [] and codes[9] == ["YEAR_MISMATCH:high:period_label"]
    assert codes[4] == ["CAPACITY_GENERATION_CONFLICT:high:unit_raw"] and codes[16] == ["ACTUAL_FORECAST_MIXED:medium:value_type", "DUPLICATE_RECORD:medium:"]
    assert len(got) == len(odd) and got[0] == 0.85 and got[1] == 0.65 and got[2] == 0.65


#: text, names, year; name, year is near, generation, report, excluded, scope, its word, evidence
ABOUT = [
    ("Dam One in 2020: annual", ["Dam One"], "2020", "dam one", False, False, False, False, "annual", "annual", None),
    ("generated 5 GWh. Calm", ["Dam One"], "2020", None, False, True, False, False, "unknown", None, "generated 5 gwh."),
    ("FY 2020", None, "2020", None, False, False, False, False, "unknown", None, None),
    ("全年发电量 7。later", ["x", "later"], "2020", "later", False, True, False, False, "annual", "全年", "全年发电量 7。"),
    (None, ["Dam One"], None, None, False, False, False, False, "unknown", None, None),
    ("招标 annual report", [], "", None, False, False, True, True, "annual", "annual", None),
    ("2019/2020 FY generated", [None, "", "x"], "2020", None, True, True, False, False, "fiscal_year", "fy", "2019/2020 fy generated"),
    ("2019 –  2020\ngenerated", ["a", "2019"], "2020", "a", True, True, False, False, "fiscal_year", "2019 – 2020", "2019 – 2020 generated"),
    ("In 2020 for the full year it generated. A 7", ["it"], "2020", "it", True, True, False, False, "annual", "full year", "2020 for the full year it generated. a 7"),
    ("7。", ["2020"], "2020", None, False, False, False, False, "unknown", None, None),
]


@pytest.mark.parametrize("together", [1, 30, 2_000_000])
def test_texts_are_asked_together(monkeypatch, together):
    """What is asked of the tables of offsets does not grow with the number of texts, and no window reaches into the next text."""
    monkeypatch.setattr(rl, "TOGETHER", together)
    calls, search = [], rl.np.searchsorted
    monkeypatch.setattr(rl.np, "searchsorted", lambda *a, **k: calls.append(1) or search(*a, **k))

    def look(rows):
        parts = [rl.look_at(*(list(c) for c in list(zip(*rows[own], strict=True))[:3])) for own in rl._together([r[0] for r in rows])]
        return [tuple(x) for p in parts for x in zip(*p, strict=True)]

    assert look(ABOUT) == [r[3:] for r in ABOUT]
    once = len(calls)
    assert look(ABOUT * 50) == [r[3:] for r in ABOUT] * 50
    assert together < 2_000_000 or len(calls) == 2 * once
    assert look(ABOUT[::-1]) == [r[3:] for r in ABOUT[::-1]]


def test_relevance_of_odd_rows(spark):
    """Null texts, names and years; partitions without rows; nulls in arrays."""
    rows = [(i, *r[:3], "calendar_year", False) for i, r in enumerate(ABOUT)]
    asked = spark.createDataFrame(rows, "id int, text string, names array<string>, year string, period_type string, disclosure boolean").repartition(16, "id")
    got = {r.id: (r.period_scope, r.scope_evidence, r.evidence, r.reason, r.text) for r in rl.relevance(asked).collect()}
    why = ["no_year", "no_name", "no_name", "no_year", "no_name", "excluded", "no_name", "fiscal_period", "confirmed", "no_name"]
    assert got == {i: (*r[8:], why[i], r[0]) for i, r in enumerate(ABOUT)}
    assert rl.relevance(asked.where("id < 0")).count() == 0

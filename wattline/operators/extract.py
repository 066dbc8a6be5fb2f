"""Documents to candidate facts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wattline.functions import text as tx

class _Page(HTMLParser):
    """Title, text, links (with their texts) and tables (headers, rows, caption) of one page; spans of cells are expanded."""

    SKIP = {"script", "style", "head", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.links, self.tables = "", [], [], []
        self.anchors: list[list] = []  # of each link the pieces of its text
        self.skip = 0
        self.in_title = self.in_link = False
        self.rows = self.row = self.cell = self.caption = None
        self.open: dict[int, list] = {}

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in self.SKIP:
            self.skip += 1
        self.in_title |= tag == "title"
        if tag == "a":
            self.in_link = bool(attrs.get("href"))
        if tag == "a" and attrs.get("href"):
            self.links.append(attrs["href"])
            self.anchors.append([])
        elif tag == "table":
            self.rows, self.open, self.caption, self.heads = [], {}, [], 0
        elif tag == "tr" and self.rows is not None:
            self.row, self.all_heads = [], True
        elif tag in ("td", "th") and self.row is not None:
            span = [int(v) if (v := attrs.get(k, "1") or "1").isdigit() else 1 for k in ("colspan", "rowspan")]
            self.cell = [[], max(1, min(span[0], 1000)), max(1, span[1])]  # HTML itself allows 1,000 columns at most
            self.all_heads &= tag == "th"

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        if tag == "a":
            self.in_link = False
        if tag == "title":
            self.in_title = False
        elif tag in ("td", "th") and self.cell is not None and self.row is not None:
            self._held()
            value = " ".join("".join(self.cell[0]).split())
            for _ in range(self.cell[1]):
                if self.cell[2] > 1:
                    self.open[len(self.row)] = [value, self.cell[2] - 1]
                self.row.append(value)
            self.cell = None
        elif tag == "tr" and self.row is not None:
            self._held()
            if self.row:
                self.heads += self.all_heads and self.heads == len(self.rows)
                self.rows.append(self.row)
            self.row = None
        elif tag == "table" and self.rows is not None:
            self.tables.append(self._table())
            self.rows = self.caption = None

    def _table(self) -> dict:
        """The first rows of header cells alone are one header: of each column the different texts, in order."""
        width = max(map(len, self.rows), default=0)
        rows = [r + [""] * (width - len(r)) for r in self.rows]
        columns = [dict.fromkeys(x for r in rows[: self.heads] if (x := r[c])) for c in range(width)]
        return {"headers": [" ".join(c) for c in columns] if self.heads else [], "rows": rows[self.heads :], "caption": " ".join("".join(self.caption).split()) or None}

    def _held(self):
        while (held := self.open.get(len(self.row))) and held[1] > 0:
            held[1] -= 1
            self.row.append(held[0])

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            into = self.cell[0] if self.cell is not None else self.caption if self.caption is not None else self.text
            into.append(data if into is not self.text else f" {data} ")
            if self.in_link:
                self.anchors[-1].append(data)


PARSED = "struct<ok:boolean,title:string,text:string,links:array<string>,link_texts:array<string>,tables:array<struct<headers:array<string>,rows:array<array<string>>,caption:string>>>"


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without the markup, with `parsed` (ok, title, text, links, link_texts, tables); null is not ok. One pass over each page."""
    kind = pa.struct([("ok", pa.bool_()), ("title", pa.string()), ("text", pa.string()), ("links", pa.list_(pa.string())), ("link_texts", pa.list_(pa.string())), ("tables", pa.list_(pa.struct([("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string()))), ("caption", pa.string())])))])

    def parse(body: str | None) -> dict:
        page = _Page()
        if body is None:
            return {"ok": False, "title": None, "text": None, "links": [], "link_texts": [], "tables": []}
        page.feed(body)
        page.close()
        return {"ok": True, "title": " ".join(page.title.split()), "text": " ".join("".join(page.text).split()), "links": page.links, "link_texts": [" ".join(" ".join(x).split()) for x in page.anchors], "tables": page.tables}

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(html)
            rest = [(c, batch.column(c)) for c in batch.schema.names if c != html]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), pa.array([parse(x.as_py()) for x in batch.column(at)], kind)], names=[*(n for n, _ in rest), "parsed"])

    return pages.mapInArrow(run, pages.drop(html).withColumn("parsed", F.lit(None).cast(PARSED)).schema)


DOCUMENT_SUFFIX = r"\.(pdf|xlsx|xls|csv|json|xml)$"
DOCUMENT_TERM = "download|attachment|report|annual|generation|production|statement|disclosure|公告|附件|下载|报告|年报|发电量"


def document_links(pages: DataFrame, page: str = "page_id", year: int | None = None, most: int = 8) -> DataFrame:
    """page, at, href, full (the absolute address) of the links that look like documents or reports: the first `most` of each page, by place.

    pages: page, url and `parsed`. A link is read as an absolute http URL; it has the suffix of a document or a term of reports in
    URL or text (of which the first 500 characters count, as the rules say). If a year is wanted, it or one next to it is in URL or text, or suffix and term both are. The page
    itself and repeats of a URL do not count.
    """
    links = pages.select(page, "url", F.posexplode(F.arrays_zip(F.col("parsed.links").alias("href"), F.col("parsed.link_texts").alias("text"))).alias("at", "x"))
    href, scheme, host = F.trim("x.href"), F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract("url", "^([^/?#]*//[^/?#]*)", 1)
    folder = F.concat(host, F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "^[^/]*//[^/]*(/.*/|/)", 1), F.lit("")), F.lit("/")))
    path = F.when(href.startswith("?") | href.startswith("#"), F.concat(F.regexp_replace("url", F.when(href.startswith("?"), "[?#].*$").otherwise("#.*$"), F.lit("")), href))
    full = F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href.startswith("/"), F.concat(host, href)).otherwise(F.coalesce(path, F.concat(folder, href)))
    links = links.select(page, "at", "url", F.col("x.href").alias("href"), full.alias("full"), F.substring("x.text", 1, 500).alias("text")).where(F.col("full").rlike("(?i)^https?://"))
    corpus = F.lower(F.concat_ws(" ", "full", "text"))
    suffix, term = F.lower(F.regexp_replace("full", "[?#].*$", "")).rlike(DOCUMENT_SUFFIX), corpus.rlike(DOCUMENT_TERM)
    dated = F.lit(True) if year is None else corpus.rlike("|".join(str(y) for y in (year - 1, year, year + 1))) | (suffix & term)
    key = [F.lower(F.regexp_replace(c, "/+$", "")) for c in ("full", "url")]
    kept = links.where((suffix | term) & dated & (key[0] != F.coalesce(key[1], F.lit("")))).withColumn("key", key[0])
    once = kept.groupBy(page, "key").agg(F.min_by(F.struct("at", "href", "full"), "at").alias("x")).select(page, "x.*")
    return once.withColumn("n", F.row_number().over(Window.partitionBy(page).orderBy("at"))).where(F.col("n") <= most).select(page, "at", "href", "full")


DUPLICATE_KEY = ("entity_id", "period_label", "value_type", "measurement_scope")


def _tested(candidates: DataFrame, stations: DataFrame, tasks: DataFrame | None, existing: DataFrame | None) -> tuple[DataFrame, list[tuple[str, str, str, str]]]:
    """candidates with a boolean column for each rule of validation, and the rules in their order: column, code, severity, field."""
    rows = candidates.join(stations.select("entity_id", "capacity_mw"), "entity_id", "left")
    if tasks is not None:
        rows = rows.join(tasks.select("task_id", "target_period", "task_period_type"), "task_id", "left")
    else:
        rows = rows.withColumns({"target_period": F.lit(None).cast("string"), "task_period_type": F.lit(None).cast("string")})
    there = F.lit(False)
    if existing is not None:
        own = existing.select(*[F.col(k).alias(f"__{k}") for k in DUPLICATE_KEY]).distinct().withColumn("__there", F.lit(True))
        same = reduce(Column.__and__, [(F.col(k).eqNullSafe(F.col(f"__{k}")) if k != "entity_id" else F.col(k) == F.col(f"__{k}")) for k in DUPLICATE_KEY])
        rows = rows.join(own, same, "left").drop(*[f"__{k}" for k in DUPLICATE_KEY])
        there = F.col("__there")
    flag = lambda *names: reduce(Column.__or__, [F.coalesce(F.array_contains("flags", n), F.lit(False)) for n in names])
    gwh, metric, kind, asked = (F.col(c) for c in ("generation_gwh", "metric", "value_type", "task_period_type"))
    rows = rows.withColumn("__years", tx.find_years(F.col("period_label")))  # once for both uses
    years = F.col("__years")
    fiscal = F.col("period_type").eqNullSafe("fiscal_year")
    rules = [
        ("UNIT_UNCLEAR", "high", "normalized_unit", ~F.col("normalized_unit").eqNullSafe("gwh")),
        ("UNIT_UNCLEAR", "high", "unit_raw", flag("UNIT_UNCLEAR")),
        ("CAPACITY_GENERATION_CONFLICT", "high", "unit_raw", flag("UNIT_NOT_ENERGY", "CAPACITY_SUSPECT")),
        ("VALUE_OUT_OF_RANGE", "high", "generation_gwh", gwh < 0),
        ("METRIC_UNCLEAR", "high", "metric", metric.isNull() | (metric == "unknown")),
        ("METRIC_MISMATCH", "high", "metric", ~metric.isin("unknown", "gross_generation")),
        ("ACTUAL_FORECAST_MIXED", "high", "value_type", kind == "forecast"),
        ("ACTUAL_FORECAST_MIXED", "medium", "value_type", kind.isNull()),
        ("ENTITY_AMBIGUOUS", "high", "measurement_scope", F.col("measurement_scope").isin("region", "complex", "group")),
        ("YEAR_MISMATCH", "high", "period_label", (F.size(years) > 0) & ~F.array_contains(years, F.col("target_period"))),
        ("YEAR_MISMATCH", "medium", "period_type", (F.coalesce(asked, F.lit("calendar_year")) == "calendar_year") & fiscal),
        ("PERIOD_AMBIGUOUS", "high", "period_type", (asked == "fiscal_year") & ~fiscal),
        ("PERIOD_AMBIGUOUS", "medium", "period_type", flag("PERIOD_UNCLEAR")),
        ("CAPACITY_GENERATION_CONFLICT", "high", "generation_gwh", (gwh > 0) & (F.col("capacity_mw") != 0) & (gwh > tx.capacity_ceiling(F.col("capacity_mw")))),
        ("DUPLICATE_RECORD", "medium", "", there),
        ("LOW_CONFIDENCE", "medium", "confidence", F.col("confidence") < 0.55),
    ]
    tests = {f"__{i}": F.coalesce(test, F.lit(False)) for i, (*_, test) in enumerate(rules)}
    return rows.withColumns(tests).drop("__there", "__years", "target_period", "task_period_type"), [(f"__{i}", *rule) for i, (*rule, _) in enumerate(rules)]


def _passed(rules: list[tuple[str, str, str, str]]) -> Column:
    return ~reduce(Column.__or__, [F.col(c) for c, code, *_ in rules if code != "LOW_CONFIDENCE"])


def _issue(code: str, severity: str, field: str, test: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(field).alias("field")))


def validate_candidates(candidates: DataFrame, stations: DataFrame, tasks: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """candidates with `issues` (code, severity, field; in the order of the rules), `passed` (nothing but low confidence), `blocking` (an issue is high), `severity` (the highest).

    candidates have `flags`, an array. stations: entity_id, capacity_mw. tasks: task_id, target_period, task_period_type: what was
    asked for; without it a calendar year is. existing: facts that are there already, by DUPLICATE_KEY.
    """
    rows, rules = _tested(candidates, stations, tasks, existing)
    issues = [_issue(code, severity, field, F.col(c)) for c, code, severity, field in rules]
    has = {level: reduce(Column.__or__, [F.col(c) for c, _, severity, _ in rules if severity == level]) for level in ("high", "medium")}
    return rows.withColumns({
        "issues": F.array_compact(F.array(*issues)), "passed": _passed(rules), "blocking": has["high"],
        "severity": F.when(has["high"], "high").when(has["medium"], "medium"),
    }).drop(*[c for c, *_ in rules])


def rule_scores(candidates: DataFrame, stations: DataFrame, tasks: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """candidates with `rule_score`: 0.8 if validate_candidates would pass them, else 0.6 less 0.3 for each high and 0.1 for each medium issue."""
    rows, rules = _tested(candidates, stations, tasks, existing)
    count = {level: reduce(Column.__add__, [F.col(c).cast("int") for c, _, severity, _ in rules if severity == level]) for level in ("high", "medium")}
    return rows.withColumn("rule_score", F.when(_passed(rules), 0.8).otherwise(0.6 - 0.3 * count["high"] - 0.1 * count["medium"])).drop(*[c for c, *_ in rules])


#: States of a project.
PROJECT_STATUS = ("newly_commissioned", "under_construction", "approved", "announced")


def validate_projects(projects: DataFrame, year: int) -> DataFrame:
    """projects with `issues` (code, severity, field) as of a year: status, capacity, dates."""
    status, since = F.coalesce(F.col("status"), F.lit("")), F.col("commissioning_year")
    running = status == "newly_commissioned"
    issues = [
        _issue("MISSING_REQUIRED_FIELD", "medium", "status", status == ""),
        _issue("PROJECT_STATUS_CONFLICT", "medium", "status", (status != "") & ~status.isin(*PROJECT_STATUS)),
        _issue("VALUE_OUT_OF_RANGE", "high", "capacity_mw", F.col("capacity_mw") < 0),
        _issue("PROJECT_DATE_CONFLICT", "medium", "commissioning_year", running & since.isNull()),
        _issue("PROJECT_DATE_CONFLICT", "high", "commissioning_year", running & (since > year)),
    ]
    return projects.withColumn("issues", F.array_compact(F.array(*issues)))


def record_confidence(rules: Column | None = None) -> Column:
    """0.8 if passed, else 0.6 less 0.3 for each high and 0.1 for each medium issue (or `rules`, the same as a number); 0.1 more for evidence, 0.05 for its page; averaged
    with the extractor's (0.5 if unknown), within 0 and 1."""
    loss = F.aggregate("issues", F.lit(0.0), lambda a, x: a + F.when(x["severity"] == "high", 0.3).when(x["severity"] == "medium", 0.1).otherwise(0.0))
    own = F.when(F.col("passed"), 0.8).otherwise(0.6 - loss) if rules is None else rules
    own += F.when(F.col("has_evidence"), 0.1).otherwise(0.0) + F.when(F.col("has_page"), 0.05).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (own + F.coalesce(F.col("confidence"), F.lit(0.5))) / 2)), 6)


#: Issues that a person must see whatever their severity.
REVIEW_CODES = ("LOW_CONFIDENCE", "ENTITY_AMBIGUOUS", "UNIT_UNCLEAR", "YEAR_MISMATCH", "PERIOD_AMBIGUOUS", "ACTUAL_FORECAST_MIXED", "CAPACITY_GENERATION_CONFLICT", "DUPLICATE_RECORD")


def needs_review() -> Column:
    """Read from an image, of a top entity (tier A), not passed, an issue that is high or in REVIEW_CODES."""
    seen = F.exists("issues", lambda x: x["code"].isin(*REVIEW_CODES))
    return F.array_contains("flags", "OCR_DERIVED") | (F.coalesce(F.col("priority_tier"), F.lit("")) == "A") | ~F.col("passed") | F.col("blocking") | seen


def promotion_gates(review_required: bool = True) -> Column:
    """Names of the gates that a candidate fails. It has `flags`, `has_evidence` and `review_status`."""
    year = (F.col("period_type") == "calendar_year") & F.col("period_label").rlike("^(?:19|20)[0-9]{2}$") & ~F.array_contains("flags", "PERIOD_UNCLEAR")
    gates = {
        "entity": F.col("entity_id") != "", "period": year, "metric": F.col("metric") == "gross_generation", "scope": F.col("measurement_scope") == "plant", "value_type": F.col("value_type") == "actual",
        "unit": (F.col("normalized_unit") == "gwh") & (tx.unit_kind(F.col("unit_raw")) == "energy") & F.col("generation_gwh").isNotNull(),
        "evidence": F.col("has_evidence"), "review": F.col("review_status") == "approved" if review_required else F.lit(True),
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(g, F.lit(False)), F.lit(n)) for n, g in gates.items()]))

"""Candidate facts in texts and tables of documents.

Python only finds where figures are: years, values and units with their sentences. What a figure is about
(metric, period, value type, scope, unit) is told by column functions on those sentences.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wattline.functions import text as tx

#: Units that follow a value, longer ones first where one begins another.
UNIT = "GWh|MWh|kWh|TWh|亿千瓦时|亿度|万千瓦时|万度|千瓦时|兆瓦时|度|GW|MW|kW|兆瓦|千瓦|万千瓦"
#: A value with its unit, and one that follows a year within 40 characters without a digit.
FIGURE = rf"(\d[\d.,]*)\s*({UNIT})"
DATED = re.compile(rf"((?:19|20)\d{{2}})\s*年?[^\d]{{0,40}}?{FIGURE}")
BARE = re.compile(FIGURE)
YEAR = re.compile(r"(?<!\d)(?:19|20)\d{2}(?!\d)")
#: A year in a document's head that is said to be the year of its generation, and words for a whole year there.
HEAD_YEAR = re.compile(r"((?:19|20)\d{2})\s*(?:年|年度|annual|year)[^。！？.!?]{0,36}(?:发电量|generation|geração|produ[cç][aã]o)", re.I)
HEAD_WHOLE = re.compile(r"全年|年度|annual|anual|full\s+year|calendar\s+year", re.I)
YEAR_HEAD, WHOLE_HEAD = 1200, 1600  # characters that count as the head
END = re.compile("[。！？；.!?;]")
LONGEST, AROUND = 500, 48  # of a sentence; on both sides where it is longer
#: Words of a column of generation, and of one that is not about amounts.
GENERATION_HEAD, CHANGE_HEAD = "发电量|generation|generated|output", "同比|增长|change|growth|%"
#: Words that name a figure in a language with a decimal comma.
DECIMAL_COMMA = "produção|geração|usina|relatório|atingiu|suprimento|energia|foram"
#: What names of facilities may end in, or hold, without being other ones.
FACILITY = ("hydroelectricplant", "hydropowerplant", "hydroelectricstation", "hydropowerstation", "powerplant", "powerstation", "水电站", "水电厂", "电站")


class Sentences:
    """The sentences of a text. Its ends are found once, so that each question is a search among them."""

    def __init__(self, text: str):
        self.text, self.ends = text, [m.start() for m in END.finditer(text)]

    def around(self, start: int, end: int) -> str:
        """The sentence around a place, or what is near if that is long."""
        i, j = bisect_left(self.ends, start), bisect_left(self.ends, end)
        left = self.ends[i - 1] + 1 if i else 0
        right = self.ends[j] if j < len(self.ends) else len(self.text)
        return self.text[left : right + 1].strip() if right - left <= LONGEST else self.text[max(0, start - AROUND) : end + AROUND]


def figures(text: str) -> list[tuple[int, str | None, str, str, str]]:
    """(place, year, value, unit, sentence) of each figure.

    A value that follows a year within 40 characters has that year. Any other has the text's only year, else the
    only year of its sentence, else the year that the text's head is about.
    """
    sentences = Sentences(text)
    dated = list(DATED.finditer(text))
    out = [(m.start(2), m[1], m[2], m[3], sentences.around(m.start(), m.end())) for m in dated]
    starts, ends = [m.start(2) for m in dated], [m.end(3) for m in dated]  # in order, and apart

    def taken(at: int) -> bool:
        i = bisect_right(starts, at) - 1
        return i >= 0 and at < ends[i]

    bare = [m for m in BARE.finditer(text) if not taken(m.start())]
    if bare:
        years = list(dict.fromkeys(YEAR.findall(text)))
        head = HEAD_YEAR.search(text[:YEAR_HEAD])
        for m in bare:
            near = sentences.around(m.start(), m.end())
            own = set(YEAR.findall(near)) if len(years) != 1 else ()
            year = years[0] if len(years) == 1 else own.pop() if len(own) == 1 else head[1] if head else None
            out.append((m.start(), year, m[1], m[2], near))
    return sorted(out)


def quoted(text: str) -> list[tuple[int, str | None, str, str, str, str]]:
    """FOUND of each figure in a text, by place."""
    hint = " 年度/全年" if HEAD_WHOLE.search(text[:WHOLE_HEAD]) else ""
    return [(at, year, value, unit, near, (near + hint).strip()) for at, (_, year, value, unit, near) in enumerate(figures(text))]


def text_figures(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, at, period_label, value_raw, unit_raw, snippet, context of each figure in a text, by place."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, rows = [], []
            for i, t in enumerate(batch.column(len(keys))):
                found = quoted(t.as_py() or "")
                which += [i] * len(found)
                rows += found
            own = batch.select(range(len(keys))).take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *_columns(rows, 6)], names=[*keys, *FOUND])

    schema = docs.select(*keys).withColumn("at", F.lit(0)).withColumns({c: F.lit(None).cast("string") for c in FOUND[1:]}).schema
    return docs.select(*keys, text).mapInArrow(run, schema)


def _columns(rows: list[tuple], n: int) -> list[pa.Array]:
    """n columns of rows: numbers, then texts."""
    return [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * n, [pa.int32(), *[pa.string()] * (n - 1)], strict=True)]


FOUND = ("at", "period_label", "value_raw", "unit_raw", "snippet", "context")


def classified(rows: DataFrame) -> DataFrame:
    """rows with what their context says: value, generation_gwh, metric, value_type, measurement_scope, period_type, flags."""
    context, unit = F.col("context"), F.col("unit_raw")
    value = tx.parse_number(F.col("value_raw"), context.rlike(f"(?iU){DECIMAL_COMMA}"))
    rows = rows.withColumns({
        "value": value, "unit_kind": tx.unit_kind(unit), "generation_gwh": value * tx.unit_factor(unit), "metric": tx.metric_clue(context), "value_type": tx.value_type_clue(context),
        "measurement_scope": tx.scope_clue(context), "period_type": F.when(F.col("period_label").isNotNull(), tx.period_type(context)),
    })
    period = F.col("period_type")
    flags = [
        ("UNIT_NOT_ENERGY", F.col("unit_kind") == "power"), ("CAPACITY_SUSPECT", F.col("unit_kind") == "power"), ("UNIT_UNCLEAR", F.col("unit_kind") == "unclear"),
        ("METRIC_UNCLEAR", F.col("metric") == "unknown"), ("PERIOD_QUARTER", period == "quarter"), ("PERIOD_FISCAL", period == "fiscal_year"),
        ("PERIOD_UNCLEAR", (period == "calendar_year") & ~tx.full_year_clue(context)), ("FORECAST_SUSPECT", F.col("value_type") == "forecast"), ("SCOPE_NOT_PLANT", F.col("measurement_scope").isin("region", "complex")),
    ]
    flag = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in flags]))
    return rows.withColumns({"normalized_unit": F.when(F.col("generation_gwh").isNotNull(), "gwh"), "snippet": F.nullif(F.substring(F.trim("snippet"), 1, 300), F.lit("")), "flags": flag}).drop("context", "unit_kind")


def extract_text(docs: DataFrame, doc_id: str, text: str, locator: str = "text") -> DataFrame:
    """Facts of whole texts, in order of their places."""
    return classified(text_figures(docs, [doc_id], text)).withColumn("locator", F.lit(locator))


def name_key(name: Column) -> Column:
    """Letters and digits of a name in lower case, without words for facilities."""
    return reduce(lambda c, word: F.replace(c, F.lit(word), F.lit("")), FACILITY, tx.compact_name(name))


def _is_target(label: Column, names: Column) -> Column:
    """Whether a row's label holds one of the names or is held by one; any label will do where there are no names."""
    key = name_key(label)
    same = lambda n: (F.length(n) >= 3) & (F.instr(key, n).cast("boolean") | F.instr(n, key).cast("boolean"))
    return F.coalesce(F.size(names) == 0, F.lit(True)) | (F.length(key) >= 3) & F.exists(F.transform(names, name_key), same)


def extract_tables(parsed: DataFrame, doc_id: str, names: str | None = None) -> DataFrame:
    """Facts of tables: figures in a row read as text with its headers, and cells of a target's row under a header of generation.

    parsed: doc_id, `parsed` (as parse_pages gives), `names` (an array; none: every row is a target's). The header
    gives the unit; it, or the caption and the other headers, the year. Columns of change, growth and quarters are left out.
    """
    return _page_facts(parsed, doc_id, names, F.col("parsed.tables"), F.lit(None).cast("array<string>"))


def extract_all(parsed: DataFrame, doc_id: str, names: str | None = None) -> DataFrame:
    """Facts of the text and of the tables of parsed pages, and, where names are given, of rows of stations in the text. A page is parsed once."""
    from wattline.operators.station_rows import row_forms  # it builds on this module

    whole = F.struct(F.array().cast("array<string>").alias("headers"), F.array(F.array("parsed.text")).alias("rows"), F.lit(None).cast("string").alias("caption"))
    forms = row_forms(F.col(names)) if names else F.lit(None).cast("array<string>")
    return _page_facts(parsed, doc_id, names, F.concat(F.array(whole), F.coalesce("parsed.tables", F.array().cast("array<struct<headers:array<string>,rows:array<array<string>>,caption:string>>"))), forms, 1)


def _page_facts(parsed: DataFrame, doc_id: str, names: str | None, tables: Column, forms: Column, texts: int = 0) -> DataFrame:
    """Facts of tables, the first `texts` of which are whole texts as tables of one cell.

    What may have figures are rows of one frame: whole texts, rows of tables as texts, and cells that are read already. So the pages are read once.
    """
    from wattline.operators.station_rows import quoted_rows  # it builds on this module

    wanted = F.col(names) if names else F.lit(None).cast("array<string>")
    tables = parsed.select(doc_id, wanted.alias("names"), forms.alias("forms"), F.posexplode(tables).alias("p", "table")).withColumn("t", F.col("p") - texts)
    rows = tables.select(doc_id, "names", F.when(F.col("t") < 0, F.col("forms")).alias("forms"), "t", F.col("table.headers").alias("headers"), F.col("table.caption").alias("caption"), F.posexplode("table.rows").alias("r", "row"))
    rows = rows.withColumns({"head": F.array_join("headers", " "), "label": F.get("row", F.lit(0))})
    # the row itself comes first, then its cells if it is a target's
    own = F.array(F.struct(F.lit(None).cast("string").alias("headers"), F.lit(None).cast("string").alias("row")))
    target = (F.col("t") >= 0) & (F.size("headers") > 0) & _is_target(F.col("label"), F.col("names"))
    parts = rows.select(doc_id, "forms", "t", "r", "caption", "head", "label", "row", F.posexplode(F.when(target, F.concat(own, F.arrays_zip("headers", "row"))).otherwise(own)).alias("c", "x")).withColumn("c", F.col("c") - 1)
    is_row, header = F.col("c") < 0, F.lower("x.headers")
    parts = parts.where(is_row | header.rlike(GENERATION_HEAD) & ~header.rlike(CHANGE_HEAD) & (tx.period_type(F.col("x.headers")) != "quarter"))
    value = F.regexp_extract(F.replace(F.col("x.row"), F.lit(" "), F.lit("")), r"(\d[\d,]*(?:\.\d+)?)", 1)
    unit = F.regexp_extract("x.headers", f"(?<![季年月度])({UNIT})", 1)
    years = [tx.find_years(c) for c in (F.col("x.headers"), F.concat_ws(" ", F.coalesce("caption", F.lit("")), "head"))]
    cell = F.when(~is_row, F.struct(F.coalesce(F.get(years[0], F.lit(0)), F.get(years[1], F.lit(0))).alias("year"), value.alias("value"), unit.alias("unit")))
    parts = parts.withColumn("cell", cell).where(is_row | F.col("cell.year").isNotNull() & (F.col("cell.value") != "") & (F.col("cell.unit") != ""))
    caption = F.when(F.coalesce(F.col("caption"), F.lit("")) != "", F.concat(F.lit("（"), "caption", F.lit("）"))).otherwise("")
    # Fixed value: the form in which a cell is quoted; its word for a station makes the scope that of a plant
    context = F.concat(F.lit("表格 "), (F.col("t") + 1).cast("string"), caption, F.lit("：电站名称="), "label", F.lit("；"), "x.headers", F.lit("="), "cell.value", F.lit(" "), "cell.unit")
    locator = F.when(F.col("t") < 0, F.lit("text")).when(is_row, F.format_string("table[%d].row[%d]", "t", "r")).otherwise(F.format_string("table[%d].row[%d].col[%d]", "t", "r", "c"))
    text = F.when(F.col("t") < 0, F.col("label")).when(is_row, F.concat("head", F.lit(" "), F.array_join("row", " ")))
    parts = parts.select(doc_id, locator.alias("locator"), is_row.alias("is_row"), text.alias("text"), "forms", F.col("cell.year").alias("period_label"), F.col("cell.value").alias("value_raw"), F.col("cell.unit").alias("unit_raw"), F.when(~is_row, context).alias("context"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, rows = [], []
            for i, (at, row, t, forms, *cell, context) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 9)), strict=True)):
                found = [(*x, at) for x in quoted(t or "")] if row else [(0, *cell, context, context, at)]
                if forms:
                    found += quoted_rows(t or "", tuple(forms), at)
                which += [i] * len(found)
                rows += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *_columns(rows, 7)], names=[doc_id, *FOUND, "locator"])

    schema = parts.select(doc_id).withColumn("at", F.lit(0)).withColumns({c: F.lit(None).cast("string") for c in (*FOUND[1:], "locator")}).schema
    return classified(parts.mapInArrow(run, schema))


def locator_meta(locator: Column) -> tuple[Column, Column]:
    """The page and the cell that a locator names, null where it does not."""
    page = F.regexp_extract(locator, r"(?i)(?:^|[.\s])page\[(\d+)\](?:\.|$)", 1)
    table = F.regexp_extract(locator, r"(?i)(table\[\d+\](?:\.row\[\d+\])?(?:\.col\[\d+\])?)", 1)
    return F.nullif(page, F.lit("")).try_cast("int"), F.nullif(table, F.lit(""))


#: Fields of a candidate in a model's answer, and what they may say.
ANSWER = "period_label string, period_type string, generation_gwh double, metric string, normalized_unit string, value_type string, measurement_scope string, value_raw string, unit_raw string, snippet string, confidence double"
ALLOWED = {
    "period_type": ("calendar_year", "fiscal_year", "quarter", "month", "ytd", "rolling_12_months"), "metric": ("gross_generation", "net_generation", "energy_sent_out", "electricity_sales", "unknown"), "normalized_unit": ("gwh",),
    "value_type": ("actual", "forecast", "estimate"), "measurement_scope": ("plant", "complex", "group", "region"),
}


def llm_candidates(answers: DataFrame, key: str, body: str) -> DataFrame:
    """key, valid, candidates (with flags) of answers that should be an object with a list `candidates` of known fields.

    Unknown fields, values of another kind, negative amounts and a confidence beyond 0 to 1 make the whole answer invalid; then it has no candidates.
    """
    names = [f.split()[0] for f in ANSWER.split(", ")]
    parsed = F.try_parse_json(body)
    items = F.try_variant_get(parsed, "$.candidates", "array<variant>")
    texts = F.from_json(F.col(body), f"candidates array<struct<{', '.join(f'{n}: string' for n in names)}>>")
    rows = answers.select(key, F.col(body).alias("body"), items.alias("items"), texts["candidates"].alias("texts"), parsed.alias("parsed"))
    keys_ok = F.forall(F.coalesce("items", F.array().cast("array<variant>")), lambda v: F.size(F.array_except(F.coalesce(F.json_object_keys(F.to_json(v)), F.array(F.lit("?"))), F.array(*map(F.lit, names)))) == 0)
    top_ok = F.coalesce(F.size(F.array_except(F.json_object_keys("body"), F.array(F.lit("candidates")))) == 0, F.lit(False))
    number = lambda x: x.isNull() | x.try_cast("double").isNotNull()
    values_ok = F.forall(
        F.coalesce("texts", F.expr(f"cast(array() as array<struct<{', '.join(f'{n}: string' for n in names)}>>)")),
        lambda c: reduce(Column.__and__, [
            *[c[n].isNull() | c[n].isin(*v) for n, v in ALLOWED.items()], number(c["generation_gwh"]), number(c["confidence"]),
            F.coalesce(c["generation_gwh"].try_cast("double") >= 0, F.lit(True)), F.coalesce(c["confidence"].try_cast("double").between(0, 1), F.lit(True)),
        ]),
    )
    rows = rows.withColumn("valid", F.coalesce(F.col("parsed").isNotNull() & top_ok & keys_ok & values_ok, F.lit(False)))

    def flags(c: Column) -> Column:
        kind = tx.unit_kind(F.coalesce(c["unit_raw"], F.lit("")))
        tests = [
            ("LLM_SOURCED", F.lit(True)), ("FORECAST_SUSPECT", c["value_type"] == "forecast"), ("SCOPE_NOT_PLANT", c["measurement_scope"].isin("region", "complex", "group")), ("METRIC_UNCLEAR", F.coalesce(c["metric"], F.lit("unknown")) == "unknown"),
            ("UNIT_NOT_ENERGY", kind == "power"), ("CAPACITY_SUSPECT", kind == "power"), ("UNIT_UNCLEAR", kind == "unclear"),
            ("PERIOD_UNCLEAR", (c["period_type"] == "calendar_year") & c["period_label"].isNotNull() & ~tx.full_year_clue(F.coalesce(c["snippet"], F.lit("")))),
        ]
        return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(n)) for n, test in tests]))

    found = F.transform("texts", lambda c: F.struct(*[(c[n].try_cast("double") if n in ("generation_gwh", "confidence") else c[n]).alias(n) for n in names], flags(c).alias("flags")))
    return rows.select(key, "valid", F.when(F.col("valid"), F.coalesce(found, F.lit(None))).alias("candidates"))

"""Tables in the text of pages that keeps their layout, and tables that go on over several pages.

Python cuts a page into lines and cells and finds its tables, in the task that reads the page; what goes on over pages is told by
windows over a document's pages. What is gathered at a time are the tables of one document that belong together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: What a number is, words of tables, those that make a table one, first cells of headers.
NUMBER = r"(?<![A-Za-z])[-+]?\d+(?:[.,]\d+)?"
HINTS = ["year", "annual", "generation", "output", "gwh", "mwh", "station", "全年", "年度", "发电", "电站", "总量", "同比", "统计"]
STRONG = ["annual", "generation", "output", "gwh", "mwh", "twh", "station", "全年", "年度", "发电", "电站", "总量", "同比", "统计"]
FIRST_CELLS = ["name", "station", "station name", "电站", "电站名称", "年份", "年度", "year", "period", "时期"]
FIRST_WORDS = ["year ", "annual ", "generation ", "年份 ", "年度 "]
NAME_CELLS = ["name", "station", "station name", "电站", "电站名称"]
YEAR_CELL = "^(?:year|period|年份|年度|时期)$"
#: Years, units and periods whose change parts tables.
YEARS = r"(?<!\d)(?:19|20)\d{2}(?!\d)"
UNITS = "(?:gwh|mwh|kwh|twh|gw|mw|kw|亿千瓦时|亿度|万千瓦时|万度|千瓦时|兆瓦时|度|兆瓦|千瓦)"
PERIODS = {"quarter": r"(?U)\bq[1-4]\b|quarter|季度|第\s*[一二三四1-4]\s*季度", "annual": "annual|year|全年|年度", "month": "month|monthly|月份|月度", "half_year": "half[- ]?year|半年|半年度"}

LINE_END = re.compile("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CUT = re.compile(f"[{WHITE}]{{2,}}|\t+")
_NUMBER, _HINT, _STRONG, _YEAR_CELL = re.compile(NUMBER, re.A), re.compile("|".join(HINTS)), re.compile("|".join(STRONG)), re.compile(YEAR_CELL)


def _cells(line: str) -> list[str]:
    """A line cut at tabs and at two blanks or more."""
    return [c for x in CUT.split(line) if (c := x.strip(" "))]


def _numeric(cells: list[str]) -> int:
    """How many cells hold a number."""
    return sum(_NUMBER.search(c) is not None for c in cells)


def _table(block: list[list[str]]) -> tuple[list[str], list[list[str]]] | None:
    """(headers, rows) of neighbouring lines, if they are a table."""

    def is_data(cells: list[str]) -> bool:
        first = cells[0].lower()
        return not (first in FIRST_CELLS or first.startswith(tuple(FIRST_WORDS))) and _numeric(cells[1:]) > 0

    begin = next((i for i, cells in enumerate(block) if i and is_data(cells)), 1)
    rows, width = block[begin:], max(map(len, block))
    if not any(map(_numeric, rows)):
        return None
    headers = [" ".join(dict.fromkeys(r[c] for r in block[:begin] if c < len(r))) for c in range(width)]
    if not (_STRONG.search(" ".join(headers).lower()) or any(_YEAR_CELL.search(h.lower()) for h in headers)):
        return None
    return headers, [r + [""] * (width - len(r)) for r in rows]


def tables_of(lines: list[tuple[str, list[str]]]) -> list[tuple[list[str], list[list[str]]]]:
    """(headers, rows) of the tables among the lines of a page, each a line and its cells."""
    blocks, near = [], False
    for line, cells in lines:
        fits = len(cells) >= 2 and bool(_NUMBER.search(line) or _HINT.search(line.lower()))
        if fits:
            blocks[-1].append(cells) if near else blocks.append([cells])
        near = fits
    return [t for b in blocks if len(b) >= 2 and (t := _table(b))]


def runs_of(lines: list[tuple[str, list[str]]]) -> list[tuple[int, list[list[str]]]]:
    """(number of cells, rows): for each number of cells the longest run of lines that may go on with a table, the first of equal ones."""
    best, run = {}, []
    for _, cells in [*lines, ("", [])]:
        n = len(cells)
        fits = n >= 2 and not _NUMBER.fullmatch(cells[0]) and cells[0].lower() not in NAME_CELLS and _numeric(cells[1:]) == n - 1
        if run and not (fits and len(run[0]) == n):
            if len(run) > len(best.get(len(run[0]), [])):
                best[len(run[0])] = run
            run = []
        if fits:
            run.append(cells)
    return list(best.items())


PAGE = "tables array<struct<headers:array<string>,rows:array<array<string>>>>, runs array<struct<width:int,rows:array<array<string>>>>"


def read_pages(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """doc, page, tables, and of pages without tables text and runs (`runs_of`). One pass over each page, no shuffle."""
    rows = pa.list_(pa.list_(pa.string()))
    kinds = [pa.list_(pa.struct([("headers", pa.list_(pa.string())), ("rows", rows)])), pa.list_(pa.struct([("width", pa.int32()), ("rows", rows)]))]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(2).to_pylist():
                lines = [(x, _cells(x)) for x in (raw.strip(WHITE) for raw in LINE_END.split(t or ""))]
                tables = tables_of(lines)
                found.append((None if tables else t, [{"headers": h, "rows": r} for h, r in tables], [] if tables else [{"width": w, "rows": r} for w, r in runs_of(lines)]))
            cols = list(zip(*found, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, [pa.string(), *kinds], strict=True))], names=[doc, page, text, "tables", "runs"])

    own = pages.select(doc, page, F.col(text).cast("string").alias(text))
    names = [x.strip().split(" ", 1) for x in PAGE.split(", ")]
    return own.mapInArrow(run, own.withColumns({n: F.lit(None).cast(k) for n, k in names}).schema)


def layout_tables(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """doc, page, nth (from 0), headers, rows of the tables of each page.

    A table is two neighbouring lines and more of two cells and more, each with a number or a word of tables. Its first lines are its header, up to the first
    that begins with no header's cell and has a number after its first cell; a column's header is what these lines have in it, each once. It must
    have a row with a number, and a strong word or a column for years in its header. Short rows are filled up.
    """
    return read_pages(pages, doc, page, text).select(doc, page, F.posexplode("tables").alias("nth", "t")).select(doc, page, "nth", "t.*")


def semantics(text: Column) -> dict[str, Column]:
    """The years, units and periods that a text names, each sorted."""
    low = F.lower(text)
    periods = F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(k)) for k, p in sorted(PERIODS.items())]))
    found = lambda p: F.sort_array(F.array_distinct(F.regexp_extract_all(low, F.lit(f"({p})"), F.lit(1))))
    return {"year": found(YEARS), "unit": found(UNITS), "period": periods}


def signature(headers: Column) -> Column:
    """Headers without signs and blanks, empty ones left out: tables with equal ones may be one."""
    return F.filter(F.transform(headers, lambda h: F.regexp_replace(F.lower(h), r"[^0-9a-z\x{4e00}-\x{9fff}]+", "")), lambda h: h != "")


def continued(read: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """read (as `read_pages` gives) with `tables` of pages that go on without a header, and `reasons` of those whose text speaks against it.

    A page without a table goes on with the last table of the page before, or with what that page went on with, unless it names a year, unit or period
    that the header, naming others, does not. It goes on with its longest run of neighbouring lines that have as many cells as the header, a first
    cell that is no number and no header's, and numbers in all others; with none the chain ends.
    """
    order = Window.partitionBy(doc).orderBy(page)
    own, has = semantics(F.coalesce(text, F.lit(""))), F.size("tables") > 0
    rows = read.select(doc, page, "tables", "runs", F.when(~has, F.struct(*[v.alias(k) for k, v in own.items()])).alias("own"))  # texts are not shuffled
    rows = rows.withColumn("anchor", F.last(F.when(has, F.struct(F.col(page).alias("page"), F.element_at("tables", -1)["headers"].alias("headers"))), ignorenulls=True).over(order))
    bare, there = ~has & F.col("anchor").isNotNull(), semantics(F.array_join("anchor.headers", " "))
    rows = rows.withColumn("there", F.when(bare, F.struct(*[v.alias(k) for k, v in there.items()])))
    changed = lambda k: (F.size(f"there.{k}") > 0) & (F.size(F.array_except(f"own.{k}", f"there.{k}")) > 0)
    against = F.when(bare, F.array_compact(F.array(*[F.when(changed(k), F.lit(f"{k}_changed")) for k in ("year", "unit", "period")])))
    width = F.size("anchor.headers")
    rows = rows.withColumns({"reasons": against, "b": F.when(bare, F.get(F.filter("runs", lambda r: r["width"] == width), F.lit(0))["rows"])})
    rows = rows.withColumn("good", F.col("b").isNotNull() & (F.size("reasons") == 0))
    chain = Window.partitionBy(doc, "anchor.page").orderBy(page)  # begins with the page of the anchor
    rows = rows.withColumns({"steps": F.row_number().over(chain) - 1, "breaks": F.sum(F.when(bare & ~F.col("good"), 1).otherwise(0)).over(chain)})
    joined = bare & (F.col(page) == F.col("anchor.page") + F.col("steps"))
    on = F.array(F.struct(F.col("anchor.headers").alias("headers"), F.col("b").alias("rows")))
    refused = joined & (F.size("reasons") > 0) & (F.col("breaks") == 1) & ~F.col("good")
    return rows.select(doc, page, F.when(joined & (F.col("breaks") == 0), on).otherwise(F.col("tables")).alias("tables"), F.when(refused, F.col("reasons")).alias("reasons"))


def page_tables(pages: DataFrame, doc: str, page: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(tables of documents, over their pages, as one: doc, first_page, last_page, headers, rows; doc, previous_page, page, reasons of pages and neighbours that are not one).

    pages: one row for each page of a document. A table goes on with the next one of its document if that is on the next page and has the same signature. Why
    neighbours on neighbouring pages do not is said: column_count_changed, year_changed, unit_changed, period_changed, or header_changed if none of these.
    Pages whose text speaks against going on have no previous page. Pages are shuffled once, by document.
    """
    order = Window.partitionBy(doc).orderBy(page, "nth")
    rows = continued(read_pages(pages, doc, page, text), doc, page, text).select(doc, page, "reasons", F.posexplode_outer("tables").alias("nth", "t")).where("t is not null or reasons is not null")
    rows = rows.select(doc, page, "reasons", "nth", "t.*").withColumn("sign", signature(F.col("headers")))
    own = F.when(F.col("headers").isNotNull(), F.struct(F.col(page).alias("page"), "headers", "sign"))
    rows = rows.withColumn("before", F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("near", F.col("headers").isNotNull() & F.coalesce(F.col(page) == F.col("before.page") + 1, F.lit(False)))
    rows = rows.withColumn("same", F.coalesce(F.col("near") & (F.col("before.sign") == F.col("sign")), F.lit(False)))
    tables = rows.where("headers is not null").withColumn("island", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(order))
    groups = tables.groupBy(doc, "island").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.sort_array(F.collect_list(F.struct(page, "nth", "headers", "rows"))).alias("parts"))
    merged = groups.select(doc, "first_page", "last_page", F.get("parts", F.lit(0))["headers"].alias("headers"), F.flatten(F.transform("parts", lambda p: p["rows"])).alias("rows"))
    own, was = semantics(F.array_join("headers", " ")), semantics(F.array_join("before.headers", " "))
    reasons = F.array_compact(F.array(F.when(F.size("headers") != F.size("before.headers"), F.lit("column_count_changed")), *[F.when(own[k] != was[k], F.lit(f"{k}_changed")) for k in ("year", "unit", "period")]))
    said = F.when(F.col("reasons").isNotNull(), F.col("reasons")).when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("header_changed")))
    notes = rows.where("reasons is not null or near and not same").select(doc, F.when(F.col("reasons").isNull(), F.col("before.page")).alias("previous_page"), page, said.alias("reasons"))
    return merged, notes

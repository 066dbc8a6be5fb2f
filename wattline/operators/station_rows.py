"""Rows of stations in text without a table's structure: a name and five figures, as PDF readers give them.

All written forms of a document's stations are patterns of one automaton, which reads the text once; at each form found
the figures are read on the spot. Only the figure of the whole year is a fact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wattline.operators.discovery import RIVERS
from wattline.operators.facts import FOUND, HEAD_WHOLE, HEAD_YEAR, UNIT, YEAR, YEAR_HEAD, classified

#: Kinds of facilities that a row may leave out; for the first two a short form of the kind stands instead.
KINDS = ("水电站", "水电厂", "hydroelectric plant", "hydropower plant", "hydroelectric station", "hydropower station", "power plant", "power station", "dam", "station")
SHORT_KIND = "电站"
#: A unit that is not the end of a word for a time, and what must not stand next to a name.
HEADER_UNIT = re.compile(rf"(?<![季年月度])({UNIT})")
LETTER = re.compile(r"[一-鿿A-Za-z]")
#: quarter, its change, year, its change
FIGURES = re.compile(r"\s+(-?\d[\d.,]*)\s+(-?\d[\d.,]*%?)\s+(-?\d[\d.,]*)\s+(-?\d[\d.,]*%?)")


def row_forms(names: Column) -> Column:
    """Forms under which rows may name a station: the names, without the river, without the facility's kind; two characters and more, the longest first."""

    def forms(n: Column) -> Column:
        short = F.regexp_replace(n, f"^(?:{RIVERS})", "")

        def bare(v: Column) -> Column:
            stem = F.trim(F.regexp_extract(v, f"(?i)^(.*?)(?:{'|'.join(KINDS)})$", 1))
            chinese = v.endswith(KINDS[0]) | v.endswith(KINDS[1])
            return F.when(stem != "", F.concat(stem, F.when(chinese, SHORT_KIND).otherwise("")))

        return F.array(n, short, bare(n), bare(short))

    clean = F.filter(F.transform(names, lambda n: F.trim(F.regexp_replace(n, r"\s+", " "))), lambda n: n != "")
    found = F.array_distinct(F.filter(F.flatten(F.transform(clean, forms)), lambda x: F.coalesce(F.length(x) >= 2, F.lit(False))))
    return F.array_sort(found, lambda a, b: F.length(b) - F.length(a))


@lru_cache(maxsize=1024)
def _automaton(forms: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, form in enumerate(forms):
        out.add_word(form, (i, form))
    out.make_automaton()
    return out


def station_rows(text: str, forms: tuple[str, ...]) -> list[tuple[str, str, str, str, str]]:
    """(station, year, value, unit, the four figures) of rows, by form and place; rows of equal year, value and unit count once.

    The text must speak of a whole year, and name a unit and a year.
    """
    text = " ".join(text.split())
    unit = HEADER_UNIT.search(text)
    if not forms or not unit or not HEAD_WHOLE.search(text):
        return []
    head, any_year = HEAD_YEAR.search(text[:YEAR_HEAD]), YEAR.search(text)
    year = head[1] if head else any_year[0] if any_year else None
    if year is None:
        return []
    found, ends = [], {}
    for last, (i, form) in _automaton(forms).iter(text):
        start = last - len(form) + 1
        if start < ends.get(i, 0) or start and LETTER.match(text[start - 1]):
            continue
        if row := FIGURES.match(text, last + 1):
            ends[i] = row.end()
            found.append((i, start, form, row))
    seen, out = set(), []
    for _, _, form, row in sorted(found, key=lambda x: x[:2]):
        if row[3] not in seen:
            seen.add(row[3])
            out.append((form, year, row[3], unit[1], " ".join(row.groups())))
    return out


def quoted_rows(text: str, forms: tuple[str, ...], locator: str) -> list[tuple[int, str, str, str, str, str, str]]:
    """FOUND and locator of each station row of a text."""
    # The forms in which a row is quoted; their words make it a whole year's generation
    return [
        (at, year, value, unit, f"{year}年全年表格行：{station} {figures}；全年总发电量 {value} {unit}", f"{year}年全年 {station} 完成发电量 {value} {unit}", f"{locator}.station_row[{station}]")
        for at, (station, year, value, unit, figures) in enumerate(station_rows(text, forms))
    ]


def extract_rows(docs: DataFrame, doc_id: str, text: str, names: str, locator: str = "text") -> DataFrame:
    """Facts of station rows, in the columns of `facts.extract_text`. `names`: an array of the names of the document's station.

    Null texts, and documents without names, have none.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, rows = [], []
            for i, (t, forms) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                found = quoted_rows(t or "", tuple(forms or ()), locator)
                which += [i] * len(found)
                rows += found
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            own = batch.column(0).take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([own, *(pa.array(c, k) for c, k in zip(cols, [pa.int32(), *[pa.string()] * 6], strict=True))], names=[doc_id, *FOUND, "locator"])

    rows = docs.select(doc_id, text, row_forms(F.col(names)).alias("forms"))
    schema = docs.select(doc_id).withColumn("at", F.lit(0)).withColumns({c: F.lit(None).cast("string") for c in (*FOUND[1:], "locator")}).schema
    return classified(rows.mapInArrow(run, schema))

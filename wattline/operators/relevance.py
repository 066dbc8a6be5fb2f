"""What candidate pages are about: whether a text shows a station's generation of a whole year.

Texts are put together and read once by an automaton of all words that matter; what it finds is kept as sorted tables of offsets, a table for each
word of each class. A window is a pair of offsets inside one text, and which words lie in it is asked of the tables for all windows of all texts at
once, so the work grows with the texts and not with their words times windows, and many short texts cost no more than a long one. What follows from the answers is told by columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Words for generation, annual reports, whole years, parts of years, fiscal years, and what is something else.
GENERATION = [
    "发电量", "上网电量", "年发电量", "年度发电", "electricity generation", "annual generation", "annual output", "generation gwh", "generation twh", "geração de energia", "geração anual", "produção de energia",
    "energia gerada", "gerou", "gerado", "gerada", "produziu", "produzindo", "produção", "generated", "produced", "producing", "elektrik üretimi", "yıllık üretim", "توليد الكهرباء", "إنتاج الكهرباء", "الطاقة المولدة",
]
ANNUAL_REPORT = ["年度报告", "年报", "发电量完成情况公告", "annual report", "sustainability report", "esg report", "relatório anual", "relatorio anual", "yıllık rapor", "السنوي"]
ANNUAL = [
    "全年", "全年度", "年度", "年内", "截至12月31日", "截至 12 月 31 日", "年度累计", "发电量完成情况公告", "annual", "full year", "year ended", "for the year", "anual", "ano inteiro", "no ano", "relatório anual", "relatorio anual",
    "yıllık", "yılında", "2022 yılı", "2023 yılı", "2024 yılı", "2025 yılı", "السنوي", "عام 2022", "عام 2023", "عام 2024", "عام 2025",
]
ANNUAL_OF_YEAR = ["em {Y}", "no ano de {Y}", "ano de {Y}", "durante {Y}", "for {Y}", "{Y} no ano"]
PARTIAL = [
    "一季度", "二季度", "三季度", "四季度", "上半年", "下半年", "半年度", "半年报", "月度", "当月", "单月", "季度", "截至6月", "截至 6 月", "截至9月", "截至 9 月", "截至10月", "截至 10 月", "截至11月", "截至 11 月",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
    "trimestre", "semestre", "mensal", "mês", "meses", "início de", "inicio de", "começo de", "beginning of", "primeiro trimestre", "segundo trimestre", "terceiro trimestre", "quarto trimestre", "primeiro semestre",
    "segundo semestre", "em janeiro", "em fevereiro", "em março", "em abril", "em maio", "em junho", "em julho", "em agosto", "em setembro", "em outubro", "em novembro", "em dezembro",
    "janeiro de", "fevereiro de", "março de", "abril de", "maio de", "junho de", "julho de", "agosto de", "setembro de", "outubro de", "novembro de", "dezembro de",
    "çeyrek", "üç aylık", "aylık", "ilk yarı", "ikinci yarı", "ربع", "النصف الأول", "النصف الثاني", "شهري",
]
#: Those of them that may be no more than a date.
DATE_LIKE = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
    "janeiro de", "fevereiro de", "março de", "abril de", "maio de", "junho de", "julho de", "agosto de", "setembro de", "outubro de", "novembro de", "dezembro de",
]
FISCAL_YEAR = ["fiscal year", "fiscal-year", "financial year", "financial-year", "财政年度", "财年", "会计年度", "fy"]
EXCLUDED = ["安全责任", "责任人名单", "任命", "招标", "中标", "采购", "招聘", "design generation", "设计年发电量", "预计发电量", "预测发电量", "cumulative generation", "累计发电量"]
#: Characters on both sides of a word of generation that tell its period, and that are its context; from a year to its figure; after it; of the evidence.
NEAR, WIDE, REACH, AFTER, LONGEST = 180, 440, 900, 160, 600

CLASSES = {"generation": GENERATION, "report": ANNUAL_REPORT, "annual": ANNUAL, "partial": PARTIAL, "fiscal": FISCAL_YEAR, "excluded": EXCLUDED}
_DATES = np.isin(PARTIAL, DATE_LIKE)
#: Between sentences: a full stop inside a number is none.
_BREAK = re.compile(r"[。！？.!?](?:(?<=[。！？])\s*|(?<=[.!?])\s+(?=[A-Za-z]))")
#: Characters of texts that are looked at together; and an offset that no text has.
TOGETHER, NOWHERE = 2_000_000, 1 << 60

_IDS = {w: i for i, w in enumerate(dict.fromkeys(chain(*CLASSES.values())))}


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, i in _IDS.items():
        out.add_word(word, i)
    out.make_automaton()
    return out


_WORDS = _automaton()


def _all(word: str, text: str) -> list[int]:
    out, at = [], text.find(word) if word else -1
    while at >= 0:
        out.append(at)
        at = text.find(word, at + 1)
    return out


@lru_cache(1000)
def _of_year(year: str) -> list[str]:
    return [w.replace("{Y}", year) for w in ANNUAL_OF_YEAR]


def _year_pairs(text: str, year: str, places: list[int]) -> list[list[tuple[int, int]]]:
    """Two years with a line between them, the second of them `year`: places of each different one."""
    if not any(text[at - 1] in "/–—-" or text[at - 2 : at] in ("/ ", "– ", "— ", "- ") for at in places if at > 4):
        return []
    found: dict[str, list[tuple[int, int]]] = {}
    for m in re.finditer(rf"(?:19|20)\d{{2}}\s*[/–—-]\s*{re.escape(year)}\b", text):
        found.setdefault(m[0], []).append(m.span())
    return list(found.values())


class Texts:
    """Texts put together, and where the words of each class are in them: for each class, tables (number of the word, starts, ends) in the order of its words.

    In a table a text has one word only; those of year and name are other words in each text. `name`: the first of a text's names that is in it.
    """

    def __init__(self, texts: list[str], names: list[list[str]], years: list[str]):
        self.texts, self.all, self.name = texts, "\n".join(texts), [None] * len(texts)  # no text and no word has a line end
        self.stop = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
        self.base = np.append(0, self.stop[:-1] + 1)
        self.tables = self._words()
        own: dict[tuple[str, int], tuple[list[int], list[int]]] = {}

        def put(kind: str, k: int, starts: list[int], ends: list[int]) -> None:
            table = own.setdefault((kind, k), ([], []))
            table[0].extend(starts)
            table[1].extend(ends)

        for i, (text, mine, year, base) in enumerate(zip(texts, names, years, self.base.tolist(), strict=True)):
            if places := _all(year, text):
                put("year", 0, [base + p for p in places], [base + p + len(year) for p in places])
                for k, word in enumerate(_of_year(year)):
                    if at := _all(word, text):
                        put("annual_of_year", k, [base + p for p in at], [base + p + len(word) for p in at])
                for k, spans in enumerate(_year_pairs(text, year, places)):
                    put("fiscal", len(FISCAL_YEAR) + k, [base + p for p, _ in spans], [base + p for _, p in spans])
            found = 0
            for word in mine:
                if at := _all(word, text):
                    self.name[i] = self.name[i] or word
                    put("name", found, [base + p for p in at], [base + p + len(word) for p in at])
                    found += 1
        for (kind, k), (starts, ends) in sorted(own.items()):
            self.tables.setdefault(kind, []).append((k, np.array(starts, np.int64), np.array(ends, np.int64)))

    def _words(self) -> dict[str, list[tuple[int, np.ndarray, np.ndarray]]]:
        hits = np.fromiter(chain.from_iterable(_WORDS.iter(self.all)), np.int64).reshape(-1, 2)
        hits = hits[np.argsort(hits[:, 1], kind="stable")]
        cuts = np.searchsorted(hits[:, 1], np.arange(len(_IDS) + 1))
        out: dict[str, list[tuple[int, np.ndarray, np.ndarray]]] = {"year": [], "annual_of_year": [], "name": []}
        for kind, words in CLASSES.items():
            out[kind] = []
            for i, word in enumerate(words):
                ends = hits[cuts[_IDS[word]] : cuts[_IDS[word] + 1], 0] + 1
                if kind == "fiscal":
                    ends = np.array([e for e in ends.tolist() if not _letter(self.all, e - len(word) - 1) and not _letter(self.all, e)], np.int64)
                if len(ends):
                    out[kind].append((i, ends - len(word), ends))
        return out

    def of(self, at: np.ndarray) -> np.ndarray:
        """The text in which an offset lies."""
        return np.searchsorted(self.base, at, "right") - 1

    def window(self, text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum(lo, self.base[text]), np.minimum(hi, self.stop[text])

    def first(self, kind: str, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each window the place in the class's tables, the start and the end of the first word that lies in it; -1 if none does."""
        out, rest = np.full((3, len(lo)), -1), np.arange(len(lo))
        for k, (_, starts, ends) in enumerate(self.tables[kind]):
            at = np.minimum(np.searchsorted(starts, lo[rest]), len(starts) - 1)
            inside = (starts[at] >= lo[rest]) & (ends[at] <= hi[rest])
            out[:, rest[inside]] = np.full(inside.sum(), k), starts[at[inside]], ends[at[inside]]
            rest = rest[~inside]
        return out

    def inside(self, kind: str, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.first(kind, lo, hi)[0] >= 0

    def places(self, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all words of a class, in the order of the words, then of the texts."""
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(s for _, s, _ in self.tables[kind])]), np.concatenate([none, *(e for _, _, e in self.tables[kind])])

    def has(self, kind: str) -> np.ndarray:
        """Whether a text has a word of the class."""
        out = np.zeros(len(self.texts), bool)
        out[self.of(self.places(kind)[0])] = True
        return out

    def best(self, text: np.ndarray, score: np.ndarray) -> np.ndarray:
        """For each text the first of its windows with the highest score, -1 for none."""
        order = np.lexsort((-score, text))
        firsts = np.flatnonzero(np.diff(text[order], prepend=-1))
        out = np.full(len(self.texts), -1)
        out[text[order[firsts]]] = order[firsts]
        return out


def _letter(text: str, i: int) -> bool:
    return 0 <= i < len(text) and "a" <= text[i] <= "z"


SCOPES = ("unknown", "annual", "partial", "fiscal_year")


def periods(t: Texts) -> tuple[list[str], list[str | None]]:
    """For each text annual, partial, fiscal_year or unknown, and the word that says so, of the place of generation closest to year and name; of the whole text if it has none."""
    start, end = t.places("generation")
    text = t.of(start)
    lo, hi = t.window(text, start - NEAR, end + NEAR)
    whole, own, part, fiscal = (t.first(k, lo, hi) for k in ("annual", "annual_of_year", "partial", "fiscal"))
    date = np.array([_DATES[i] for i, *_ in t.tables["partial"]] or [False])
    part[0, (part[0] >= 0) & date[part[0]] & (t.has("annual") | t.has("annual_of_year"))[text]] = -1  # the name of a month may be a date of the page
    kind = np.select([part[0] >= 0, fiscal[0] >= 0, (whole[0] >= 0) | (own[0] >= 0)], [2, 3, 1], 0)
    word = np.select([kind == 2, kind == 3, whole[0] >= 0], [part[1:], fiscal[1:], whole[1:]], own[1:])
    best = t.best(text, kind + 5 * t.inside("year", lo, hi) + 4 * t.inside("name", lo, hi))
    scopes, words = np.zeros(len(best), np.int64), np.full((2, len(best)), -1)
    there, none = np.flatnonzero(best >= 0), np.flatnonzero(best < 0)
    scopes[there], words[:, there] = kind[best[there]], word[:, best[there]]
    whole, part = (t.first(k, t.base[none], t.stop[none]) for k in ("annual", "partial"))
    scopes[none], words[:, none] = np.select([whole[0] >= 0, part[0] >= 0], [1, 2], 0), np.where(whole[0] >= 0, whole[1:], part[1:])
    return [SCOPES[k] for k in scopes.tolist()], [t.all[a:b] if k else None for k, a, b in zip(scopes.tolist(), *words.tolist(), strict=True)]


def year_is_near(t: Texts) -> np.ndarray:
    """For each text whether the year is in the surroundings of that word of generation which say most."""
    start = np.sort(t.places("generation")[0])
    text = t.of(start)
    lo, hi = t.window(text, start - WIDE, start + WIDE)
    year, yes = t.inside("year", lo, hi), lambda k: t.inside(k, lo, hi).astype(int)
    best = t.best(text, 5 * year + 4 * yes("annual") + 4 * yes("fiscal") - 5 * yes("partial") + 3 * yes("name"))
    return (best >= 0) & np.append(year, False)[best]


def _next(places: tuple[np.ndarray, np.ndarray], at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The end of the first word that begins at an offset or after it and before stop; NOWHERE if none does."""
    order = np.argsort(places[0], kind="stable")
    start, end = (np.append(x[order], NOWHERE) for x in places)
    k = np.searchsorted(start, at)
    return np.where(start[k] < stop, end[k], NOWHERE)


def evidence(t: Texts) -> list[str | None]:
    """For each text with a word of generation what shows period and figure: the shortest way from the year over a word for the whole year to one of generation,
    to the end of the sentence; else the sentence that says most."""
    out: list[str | None] = [None] * len(t.texts)
    year, year_end = t.places("year")
    text = t.of(year)
    over = _next(t.places("annual"), year_end, t.stop[text])
    figure = _next(t.places("generation"), np.minimum(over, t.stop[text]), t.stop[text])
    way = np.flatnonzero((over <= year_end + REACH) & (figure <= year_end + REACH))
    year, text, figure = year[way], text[way], figure[way]
    stops = np.array(_all("。", t.all), np.int64)
    stop = _next((stops, stops + 1), figure, t.stop[text])
    end = np.minimum(np.where(stop < NOWHERE, stop, figure + AFTER), t.stop[text])
    best = t.best(text, year - end)
    for i in np.flatnonzero(best >= 0).tolist():
        out[i] = " ".join(t.all[year[best[i]] : end[best[i]]].split())[:LONGEST]
    lo, hi = [], []
    for i in np.flatnonzero((best < 0) & t.has("generation")).tolist():
        base, own = int(t.base[i]), t.texts[i]
        cuts = [base, *(base + m.end() for m in _BREAK.finditer(own)), base + len(own)]
        lo += cuts[:-1]
        hi += cuts[1:]
        out[i] = own[:LONGEST]
    lo, hi = np.array(lo, np.int64), np.array(hi, np.int64)
    text = np.searchsorted(t.stop, lo)
    score = 4 * t.inside("year", lo, hi) + 4 * t.inside("annual", lo, hi) + 3 * t.inside("generation", lo, hi)
    best = t.best(text, score)
    for i in np.flatnonzero((best >= 0) & (np.append(score, 0)[best] > 0)).tolist():
        out[i] = t.all[lo[best[i]] : hi[best[i]]].strip()[:LONGEST]
    return out


SEEN = {"alias": "string", "has_year": "boolean", "has_generation": "boolean", "has_report": "boolean", "excluded": "boolean", "period_scope": "string", "scope_evidence": "string", "evidence": "string"}


def look_at(texts: list[str | None], names: list[list[str | None] | None], years: list[str | None]) -> tuple:
    """The columns SEEN of these texts."""
    t = Texts([" ".join((x or "").lower().split()) for x in texts], [[n.lower() for n in x or [] if n] for x in names], [y or "" for y in years])
    return t.name, year_is_near(t), t.has("generation"), t.has("report"), t.has("excluded"), *periods(t), evidence(t)


def _together(texts: list[str | None]) -> Iterator[slice]:
    """Rows whose texts have some TOGETHER characters, one row at least."""
    begin = size = 0
    for i, x in enumerate(texts):
        size += len(x or "") + 1
        if size >= TOGETHER or i + 1 == len(texts):
            yield slice(begin, i + 1)
            begin, size = i + 1, 0


def _lists(column: pa.ListArray) -> list[list[str | None]]:
    flat, ends = column.flatten().to_pylist(), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def relevance(candidates: DataFrame) -> DataFrame:
    """candidates with eligible, score, reason (a code), period_scope, scope_evidence (the word that tells the scope), evidence.

    Columns: text (all that is known of the candidate), names (array, see station_aliases), year, period_type (calendar_year or
    fiscal_year), disclosure (whether it is an operator's disclosure that names its stations only inside). Blanks and line ends count as one
    blank. A null text says nothing.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names, years = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "names", "year"))
            cols = texts.to_pylist(), _lists(names), years.to_pylist()
            parts = [look_at(*(c[own] for c in cols)) for own in _together(cols[0])]
            made = [pa.array(list(chain.from_iterable(p[i] for p in parts)), pa.bool_() if k == "boolean" else pa.string()) for i, k in enumerate(SEEN.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *SEEN])

    schema = candidates.withColumns({n: F.lit(None).cast(k) for n, k in SEEN.items()}).schema
    seen = candidates.mapInArrow(run, schema).withColumn("reason", _reason())
    own = 0.55 + 0.20 + 0.15 + F.when(F.col("has_generation"), 0.10).otherwise(0.0)
    score = F.when(F.col("reason") == "disclosure", 0.72).when(F.col("reason") == "confirmed", own).otherwise(0.0)
    return seen.withColumns({"eligible": F.col("reason").isin("confirmed", "disclosure"), "score": F.least(F.lit(1.0), score)}).drop("alias", "has_year", "has_generation", "has_report", "excluded")


def _reason() -> Column:
    """The first gate that decides."""
    fiscal, scope = F.col("period_type") == "fiscal_year", F.col("period_scope")
    wanted = F.when(fiscal, "fiscal_year").otherwise("annual")
    deferred = F.col("alias").isNull() & F.col("disclosure") & F.col("has_year") & F.col("has_generation")
    return (
        F.when(F.col("excluded") & ~(F.col("has_generation") & F.col("has_report")), "excluded")
        .when(deferred & (scope == "partial"), "partial_period").when(deferred & (scope == wanted), "disclosure")
        .when(F.col("alias").isNull(), "no_name").when(~F.col("has_year"), "no_year").when(~(F.col("has_generation") | F.col("has_report")), "no_generation")
        .when(scope == "partial", "partial_period").when(~fiscal & (scope == "fiscal_year"), "fiscal_period").when(scope != wanted, "unclear_period").otherwise("confirmed")
    )

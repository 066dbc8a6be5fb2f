"""Phrases to search for a station's figures: by language, after failures, and for engines with boolean operators."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

#: Countries of a language; Chinese and Arabic names tell themselves.
COUNTRIES = {
    "portuguese": ["brazil", "brasil", "portugal"], "turkish": ["turkey", "türkiye", "turkiye"],
    "arabic": ["egypt", "مصر", "sudan", "السودان", "iraq", "العراق", "syria", "سوريا", "morocco", "المغرب", "algeria", "الجزائر"],
}
#: Phrases of generation by language, with what they look for; the last asks by the operator ({O}), Chinese without an operator has one of its own.
GENERATION = {
    "chinese": [("station_annual_generation", "{N} {Y} 完成发电量"), ("station_full_year_generation", "{N} {Y} 全年 发电量"), ("operator_annual_disclosure", "{O} {Y} 发电量完成情况公告"), ("annual_report_index", "{N} {Y} 发电量 年度报告")],
    "portuguese": [("station_annual_generation", "{N} {Y} geração anual"), ("annual_report_index", "{N} {Y} relatório anual geração"), ("operator_annual_disclosure", "{O} {Y} geração {N}")],
    "turkish": [("station_annual_generation", '"{N}" {Y} yıllık elektrik üretimi'), ("annual_report_index", '"{N}" {Y} yıllık faaliyet raporu üretim'), ("operator_annual_disclosure", '"{O}" {Y} yıllık üretim raporu "{N}"')],
    "arabic": [("station_annual_generation", '"{N}" {Y} إنتاج الكهرباء السنوي'), ("annual_report_index", '"{N}" {Y} التقرير السنوي إنتاج الكهرباء'), ("operator_annual_disclosure", '"{O}" {Y} التقرير السنوي إنتاج "{N}"')],
    "other": [("station_annual_generation", '"{N}" {Y} annual generation'), ("annual_report_index", '"{C}" {Y} annual report generation'), ("operator_annual_disclosure", '"{O}" {Y} annual report "{N}" generation')],
}
CAPACITY = [("station_capacity", '"{N}" {Y} installed capacity MW'), ("capacity_report", '"{C}" {Y} capacity report')]
#: A phrase for each site that is known, by metric; the words for a fiscal year.
SITE = {"generation": 'site:{D} "{N}" {Y} annual generation', "capacity": 'site:{D} "{N}" {Y} capacity report'}
FISCAL = {"chinese": " 财政年度", "arabic": " 财政年度"}
#: Marks of failures of the network, after which nothing more is asked, and of pages that were about something else.
NETWORK = ["timeout", "429", "captcha", "验证码", "waf", "dns", "tls", "不可用"]
IRRELEVANT = ["irrelevant", "ineligible", "无关", "不相关"]
PREFERRED = ["operator_annual_disclosure", "annual_report_index", "verified_site_report_index"]
#: Phrases after a search that found nothing.
AGAIN = {
    "capacity": [("capacity_pdf", '"{N}" {Y} filetype:pdf installed capacity'), ("capacity_official", '"{N}" {Y} official capacity data')],
    "chinese": [("annual_report_index", "{N} {Y} 年度报告 发电量"), ("annual_pdf_disclosure", "{N} {Y} 公告 全年 发电量 pdf")],
    "other": [("annual_pdf_disclosure", '"{N}" {Y} annual generation filetype:pdf'), ("operating_statistics", '"{N}" {Y} operating statistics report')],
}
#: Names of country codes, and words of a metric, in boolean form.
NAMES = {"CN": "China", "BR": "Brazil", "US": "United States", "CA": "Canada", "RU": "Russia", "IN": "India", "VE": "Venezuela", "CO": "Colombia", "NO": "Norway", "TR": "Turkey"}
WORDS = {"generation": '(generation OR "electricity production" OR output) (GWh OR TWh OR "billion kWh")', "capacity": '(capacity OR "installed capacity" OR power) (MW OR GW OR megawatt)'}

PHRASE = "array<struct<query:string,family:string>>"


def _filled(template: str, **parts: Column) -> Column:
    """The template with its parts put in; null if one of `parts` is, whether it is in the template or not."""
    pieces = [parts[x] if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"\{([A-Z])\}", template)) if x != ""]
    absent = [F.when(v.isNotNull(), F.lit("")) for k, v in parts.items() if "{" + k + "}" not in template]
    return F.concat(*pieces, *absent)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _phrases(templates: list[tuple[str, str]], **parts: Column) -> Column:
    return F.array(*[F.struct(_filled(t, **parts).alias("query"), F.lit(family).alias("family")) for family, t in templates])


def _any_of(text: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])


def is_chinese(name: Column) -> Column:
    return F.coalesce(name.rlike(r"[一-鿿]"), F.lit(False))


def language(name: Column, country: Column) -> Column:
    home = F.lower(F.trim(F.coalesce(country, F.lit(""))))
    out = F.when(is_chinese(name), "chinese")
    for kind, homes in COUNTRIES.items():
        out = out.when(home.isin(*homes) | (F.coalesce(name.rlike(r"[؀-ۿ]"), F.lit(False)) if kind == "arabic" else F.lit(False)), kind)
    return out.otherwise("other")


def query_variants(name: Column, operator: Column, country: Column, year: Column, domains: Column, fiscal: Column, metric: Column | None = None, canonical: Column | None = None, most: int = 3) -> Column:
    """(query, family) of the first `most` (at most 5) different phrases for a station's generation or capacity of a year.

    canonical: the station's standard name, where that is another one. domains: sites that are known to be its operator's.
    """
    metric, canonical = F.coalesce(metric, F.lit("generation")) if metric is not None else F.lit("generation"), name if canonical is None else F.coalesce(canonical, name)
    capacity = metric == "capacity"
    short = F.trim(F.regexp_replace(name, r"(?i)^(?:usina\s+hidrel[eé]trica|central\s+hidrel[eé]trica)\s+", ""))
    who = F.trim(F.coalesce(operator, F.lit("")))

    def of(kind: str) -> Column:
        span = F.concat(year, F.when(fiscal, FISCAL.get(kind, " fiscal year")).otherwise(""))
        own = F.when(short != "", short).otherwise(name) if kind == "portuguese" else name
        found = _phrases(GENERATION[kind], N=own, C=canonical, O=who, Y=span)
        last = F.lit("annual_report_index") if kind == "chinese" else F.lit(None).cast("string")
        kept = F.filter(found, lambda x, i: F.when(x["family"] == "operator_annual_disclosure", who != "").when((i == 3) & (x["family"] == last), who == "").otherwise(True))
        return kept

    by_language = lambda tongue: reduce(lambda c, kind: c.when(tongue == kind, of(kind)), list(GENERATION)[1:], F.when(tongue == "chinese", of("chinese")))
    sized = _phrases(CAPACITY, N=name, C=canonical, Y=F.concat(year, F.when(fiscal, " fiscal year").otherwise("")))
    sites = F.filter(F.transform(F.coalesce(domains, F.array().cast("array<string>")), lambda d: F.regexp_replace(F.lower(F.trim(d)), r"^www\.", "")), lambda d: d != "")
    site = F.transform(sites, lambda d: F.struct(F.when(capacity, _filled(SITE["capacity"], D=d, N=name, Y=year)).otherwise(_filled(SITE["generation"], D=d, N=name, Y=year)).alias("query"), F.lit("verified_site_report_index").alias("family")))
    return F.slice(first_of_each(F.concat(F.when(capacity, sized).otherwise(_bound(language(name, country), by_language)), site)), 1, max(1, min(most, 5)))


def first_of_each(phrases: Column) -> Column:
    """Phrases without those whose query came before."""
    return _bound(phrases, lambda all_: F.filter(all_, lambda x, i: F.array_position(F.transform(all_, lambda y: y["query"]), x["query"]) == i + 1))


def rewrite_after_failure(name: Column, operator: Column, country: Column, year: Column, domains: Column, fiscal: Column, metric: Column, failure: Column, attempted: Column, most: int = 2) -> Column:
    """(query, family) of at most two phrases to try next, without those that were tried.

    After a failure of the network none; after pages about something else, those of the first five phrases that ask operators, reports and known sites; after
    anything else (mostly that nothing was found), phrases for files and statistics.
    """
    code = F.lower(F.trim(F.coalesce(failure, F.lit(""))))
    other = F.filter(query_variants(name, operator, country, year, domains, fiscal, metric, most=5), lambda x: x["family"].isin(*PREFERRED))
    again = F.when(metric == "capacity", _phrases(AGAIN["capacity"], N=name, Y=year)).when(is_chinese(name), _phrases(AGAIN["chinese"], N=name, Y=year)).otherwise(_phrases(AGAIN["other"], N=name, Y=year))
    found = F.when(_any_of(code, NETWORK), F.expr(f"cast(array() as {PHRASE})")).when(_any_of(code, IRRELEVANT), other).otherwise(again)
    tried = F.transform(F.coalesce(attempted, F.array().cast("array<string>")), lambda q: F.trim(q))
    return F.slice(_bound(tried, lambda known: F.filter(found, lambda x: ~F.array_contains(known, x["query"]))), 1, max(1, min(most, 2)))


def boolean_query(name: Column, country: Column, year: Column, metric: Column) -> Column:
    """A phrase with operators: the name in quotes, country, year, and words of the metric; what is not known is left out."""
    home = reduce(lambda c, kv: c.when(country == kv[0], kv[1]), NAMES.items(), F.when(F.lit(False), "")).otherwise(F.nullif(country, F.lit("")))
    words = reduce(lambda c, kv: c.when(metric == kv[0], kv[1]), WORDS.items(), F.when(F.lit(False), ""))
    return F.array_join(F.array_compact(F.array(F.concat(F.lit('"'), name, F.lit('"')), home, year.cast("string"), words)), " ")

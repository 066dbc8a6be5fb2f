"""Finding sources: kinds of downloads, scores, search phrases and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattline.functions import text as tx

# ---- downloads --------------------------------------------------------------------------------

#: Phrases of pages that block or check visitors.
BLOCK_PHRASES = ("access denied", "403 forbidden", "are you a robot", "verifying you are human", "captcha", "cloudflare", "just a moment", "请开启 javascript", "enable javascript", "unusual traffic", "请稍候", "人机验证")
BLOCK_HEAD, HTML_HEAD, PDF_HEAD, JSON_HEAD, CSV_HEAD = 8192, 2048, 1024, 64, 256  # characters looked at: the rules are about a file's head


def _head(body: Column, n: int) -> Column:
    return F.regexp_replace(F.substring(body, 1, n), "^[\\s﻿]+", "")


def looks_like_html(body: Column, content_type: Column) -> Column:
    head = F.lower(_head(body, HTML_HEAD))
    return F.lower(F.coalesce(content_type, F.lit(""))).contains("html") | head.startswith("<!doctype html") | head.startswith("<html") | head.contains("<head") | head.contains("<body")


def content_kind(body: Column, content_type: Column) -> Column:
    """pdf, excel, csv, json, html or unknown: magic bytes first, then the declared type, then how the body begins."""
    kind, magic = F.lower(F.coalesce(content_type, F.lit(""))), F.hex(F.substring(body, 1, 4))
    csv = F.substring(body, 1, CSV_HEAD)
    return (
        F.when(_head(body, PDF_HEAD).startswith("%PDF-"), "pdf").when(magic.isin("504B0304", "D0CF11E0"), "excel")
        .when(kind.contains("pdf"), "pdf").when(kind.rlike("spreadsheet|excel"), "excel").when(kind.contains("csv"), "csv").when(kind.contains("json"), "json")
        .when(looks_like_html(body, content_type), "html").when(_head(body, JSON_HEAD).rlike(r"^[{\[]"), "json")
        .when(csv.contains(",") & csv.contains("\n") & ~csv.contains("<"), "csv").otherwise("unknown")
    )


def block_page(body: Column, content_type: Column) -> Column:
    """Whether a page of HTML only blocks or checks the visitor."""
    head = F.lower(F.substring(body, 1, BLOCK_HEAD))
    return looks_like_html(body, content_type) & reduce(Column.__or__, [head.contains(p) for p in BLOCK_PHRASES])


def fetch_code(status: Column, content_type: Column, body: Column, expected: Column, most: int) -> Column:
    """What is wrong with a download, the first of: status, empty, too large, blocked, another kind than expected ('any' for none); else ok."""
    kind = content_kind(body, content_type)
    size = F.octet_length(body)
    return (
        F.when(status.isin(403, 404, 429), F.concat(F.lit("http_"), status.cast("string"))).when(~status.between(200, 299), "http_error")
        .when(F.coalesce(size, F.lit(0)) == 0, "empty_body").when(size > most, "too_large").when(block_page(body, content_type), "html_block_page")
        .when((expected == "pdf") & (kind != "pdf"), "not_pdf").when((expected != "any") & (kind != expected), "not_expected_type").otherwise("ok")
    )


def probe_status(status: Column, content_type: Column, document_type: Column, url: Column) -> Column:
    """access and state of a probed link. A PDF that comes as HTML, and what is refused, needs a browser; no status: the probe failed."""
    declared = (F.lower(F.coalesce(document_type, F.lit(""))) == "pdf") | F.lower(F.substring_index(url, "?", 1)).endswith(".pdf")
    reached = status.between(200, 399)
    both = lambda a, s: F.struct(F.lit(a).alias("access"), F.lit(s).alias("state"))
    out = F.when(reached & declared & F.lower(F.coalesce(content_type, F.lit(""))).contains("html"), both("requires_browser", "discovered"))
    return out.when(reached, both("reachable", "discovered")).when(status.isin(401, 403, 429), both("requires_browser", "discovered")).when(status.isNotNull(), both("unavailable", "unavailable")).otherwise(both("unknown", "unavailable"))


# ---- scores -----------------------------------------------------------------------------------

#: Reliability of known publishers and their subdomains.
TRUSTED = {
    "iea.org": 0.90, "worldbank.org": 0.90, "irena.org": 0.90, "hydropower.org": 0.85, "eia.gov": 0.95, "usace.army.mil": 0.90, "energy.gov": 0.90, "globalenergymonitor.org": 0.80,
    "nea.gov.cn": 0.95, "ctg.com.cn": 0.90, "powerchina.cn": 0.85, "chnenergy.com.cn": 0.85,
}
#: Reliability of kinds of sources, and what their address adds.
BASE_SCORE, OTHER_SCORE = {"official": 0.90, "authority": 0.80, "search_result": 0.40}, 0.50
GOV, ORG, HTTPS = 0.10, 0.05, 0.02


def clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def score_reliability(url: Column, source_type: Column) -> Column:
    """A known publisher's score; else that of the kind of source, more for government and organisations and for https."""
    name = F.regexp_replace(tx.host(url), r"\.$", "")
    known = F.coalesce(*[F.when((name == d) | name.endswith(f".{d}"), F.lit(s)) for d, s in TRUSTED.items()])
    base = reduce(lambda c, kv: c.when(source_type == kv[0], F.lit(kv[1])), BASE_SCORE.items(), F.when(F.lit(False), 0.0)).otherwise(OTHER_SCORE)
    bonus = F.when(name.rlike(r"\.gov(\.[a-z]{2})?$"), GOV).when(name.rlike(r"\.org(\.[a-z]{2})?$"), ORG).otherwise(0.0)
    return F.coalesce(known, clamped(base + bonus + F.when(F.lower(url).startswith("https://"), HTTPS).otherwise(0.0)))


def score_fit(url: Column, document_type: Column, name: Column, year: Column, metric: Column, preview: Column) -> Column:
    """How well a source fits a task: 0.5, and more for the year and the name in its address, an annual report, and words of the task in what is known of its text."""
    where, bare = F.lower(F.coalesce(url, F.lit(""))), lambda c: F.replace(F.replace(F.lower(c), F.lit(" "), F.lit("")), F.lit("-"), F.lit(""))
    add = lambda test, x: F.when(F.coalesce(test, F.lit(False)), x).otherwise(0.0)
    report = F.when(where.rlike("annual-report|year-report|annualreport"), 0.10).when(F.lower(F.coalesce(document_type, F.lit(""))) == "pdf", 0.05).otherwise(0.0)
    words = F.array(F.lower(name), year, metric, F.lit("gwh"), F.lit("electricity"))
    found = F.size(F.filter(words, lambda w: (w != "") & F.contains(F.lower(F.coalesce(preview, F.lit(""))), w)))
    return clamped(0.5 + add((year != "") & F.contains(where, year), 0.20) + add((bare(name) != "") & F.contains(bare(where), bare(name)), 0.20) + report + found / 5 * 0.30)


def rank_sources(sources: DataFrame) -> DataFrame:
    """sources with reliability, fit and score (0.6 and 0.4 of them). Columns: url, source_type, document_type, name, year, metric, preview."""
    fit = score_fit(*(F.col(c) for c in ("url", "document_type", "name", "year", "metric", "preview")))
    return sources.withColumns({"reliability": score_reliability(F.col("url"), F.col("source_type")), "fit": fit}).withColumn("score", F.col("reliability") * 0.6 + F.col("fit") * 0.4)


#: Of each channel the score of other hosts, the marks of hosts with the scores they give (the first that fits), and what a PDF adds.
ESTIMATES = {
    "sitemap": (0.70, {r"\.gov|official": 0.85, r"\.edu|\.org": 0.80}, 0.05),
    "navigation": (0.70, {r"\.gov|official": 0.85, r"\.edu|\.org": 0.80}, 0.05),
    "search": (0.50, {r"\.gov|government": 0.85, r"\.edu|\.org|official": 0.75, "wikipedia": 0.70}, 0.10),
}
FIRST_LEVEL = 0.65  # of a link on the entry page itself, found by navigation


def estimate_reliability(url: Column, document_type: Column, channel: Column, depth: Column) -> Column:
    """A first guess by the host, the channel and the kind of document."""
    name, out = tx.host(url), None
    for kind, (other, marks, pdf) in ESTIMATES.items():
        score = reduce(lambda c, kv: c.when(name.rlike(kv[0]), F.lit(kv[1])), marks.items(), F.when(F.lit(False), 0.0))
        score = score.otherwise(F.when(depth == 1, FIRST_LEVEL).otherwise(other) if kind == "navigation" else F.lit(other)) + F.when(document_type == "pdf", pdf).otherwise(0.0)
        out = F.when(channel == kind, score) if out is None else out.when(channel == kind, score)
    return F.least(F.lit(1.0), out.otherwise(0.5))


# ---- names and phrases ------------------------------------------------------------------------

#: Words of names that are not names of their own.
NAME_STOP = ("dam", "hydroelectric", "hydropower", "power", "plant", "station", "baraj", "baraji", "hes", "usina", "hidrelétrica", "hidreletrica", "paraguay", "side", "high", "the", "de", "of", "and")
#: Rivers that names may begin with.
RIVERS = "长江|金沙江|雅砻江|澜沧江|黄河|珠江|红水河"


def station_aliases(names: Column) -> Column:
    """Forms under which a station may be written: its names, core words of names without Chinese characters, and names
    without the facility's kind or the river; at least three characters each (core words four), in order."""

    def forms(n: Column) -> Column:
        words = F.filter(F.regexp_extract_all(F.lower(n), F.lit(r"([\p{IsLatin}\p{IsCyrillic}]+)"), F.lit(1)), lambda w: (F.length(w) >= 4) & ~w.isin(*NAME_STOP))
        plain = F.regexp_replace(F.regexp_replace(n, r"(?i)\s+(?:dam\s+)?(?:hydroelectric|hydropower|power)\s+(?:plant|station)$", ""), "^[ —-]+|[ —-]+$", "")
        river = F.regexp_replace(n, f"^(?:{RIVERS})", "")
        short = F.regexp_replace(river, "水电(?:站|厂)$", "电站")
        core = F.when(n.rlike(r"[一-鿿]"), F.array().cast("array<string>")).otherwise(words)
        return F.filter(F.concat(F.array(n), core, F.array(plain, river, short)), lambda x: F.length(x) >= 3)

    trimmed = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.flatten(F.transform(trimmed, forms)))


#: Where sites keep annual reports.
REPORT_PATHS = (
    "annual-report-{Y}.pdf", "reports/{Y}/annual-report.pdf", "investor-relations/reports/{Y}", "en/reports/{Y}", "about-us/annual-reports/{Y}",
    "sustainability/reports/{Y}", "ir/reports/{Y}.pdf", "documents/annual-report-{Y}.pdf", "media/reports/annual-{Y}.pdf", "annual-reports/{Y}",
)


def report_urls(site: Column, year: Column) -> Column:
    """Addresses under a site where the report of a year may be."""
    base = F.concat(F.regexp_replace(site, "/$", ""), F.lit("/"))
    return F.array(*[F.concat(base, F.replace(F.lit(p), F.lit("{Y}"), year)) for p in REPORT_PATHS])


def expand_attachments(links: DataFrame, known: DataFrame, total: int = 20) -> DataFrame:
    """Links (page_id, at, url, href, full; the first few of each page) as candidates of their own: those whose address no
    page has, each once (of the first page and place), `total` for each group of pages. known: url."""
    key = lambda c: F.lower(F.regexp_replace(c, "/+$", ""))
    rows = links.withColumn("key", key("full"))
    rows = rows.join(known.select(key("url").alias("key")).distinct(), "key", "left_anti")
    once = rows.groupBy("key").agg(F.min_by(F.struct("group", "page_id", "at", "url", "full"), F.struct("page_id", "at")).alias("x")).select("x.*")
    order = F.row_number().over(Window.partitionBy("group").orderBy("page_id", "at"))
    kept = once.withColumn("n", order).where(F.col("n") <= total)
    return kept.select("page_id", "at", F.col("full").alias("url"), F.col("url").alias("parent_url"), tx.doc_type(F.col("full")).alias("document_type"), tx.stable_id("cand_", F.col("url"), F.col("full")).alias("id"))


# ---- whose figure it is -----------------------------------------------------------------------

#: Addresses of one country's sources, countries whose sources speak only of themselves, and words that name a country.
SOURCE_HOME = {"US": ["eia.gov"], "CN": ["stats.gov.cn", ".cn/"], "BR": [".gov.br"]}
OWN_ONLY = ["US", "CN", "BR", "CA", "IN"]
COUNTRY_WORDS = {
    "US": ["united states", "u.s.", "usa", "american", "eia-"],
    "CN": ["china", "chinese", "中国", "中华", "prc"],
    "BR": ["brazil", "brazilian", "brasil"],
}


def source_country(url: Column) -> Column:
    """The country whose source this is, where the address says so."""
    hit = lambda words: reduce(Column.__or__, [url.contains(w) for w in words])
    return F.coalesce(*[F.when(hit(words), F.lit(k)) for k, words in SOURCE_HOME.items()])


def country_conflict(country: Column, url: Column, text: Column) -> Column:
    """Why a source or a text cannot be about an entity of this country: source_country, text_country or null."""
    return home_conflict(country, source_country(url), text)


def home_conflict(country: Column, home: Column, text: Column) -> Column:
    """The same by the country whose source it is, null where that is not known."""
    low = F.lower(F.coalesce(text, F.lit("")))
    names = {k: reduce(Column.__or__, [low.contains(w) for w in words]) for k, words in COUNTRY_WORDS.items()}
    other = (
        (country == "US") & names["CN"] & ~names["US"] | (country == "CN") & names["US"] & ~names["CN"]
        | (country == "BR") & (names["US"] | names["CN"]) & ~names["BR"]
    )
    return F.when(home.isin(*OWN_ONLY) & (home != country), "source_country").when(F.coalesce(other, F.lit(False)), "text_country")

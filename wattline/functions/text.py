"""Column functions: cleaning, units, numbers, URLs, first-match text rules, identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# ---- cleaning ---------------------------------------------------------------------------------


def clean(c: Column) -> Column:
    """Trimmed; empty is null."""
    return F.nullif(F.trim(c), F.lit(""))


def clean_float(c: Column) -> Column:
    return clean(c).try_cast("double")


def clean_int(c: Column) -> Column:
    """Through a float, so that 1990.0 is 1990."""
    return clean_float(c).try_cast("int")


def clean_bool(c: Column) -> Column:
    return F.coalesce(F.lower(clean(c)).isin("1", "true", "yes", "y", "t"), F.lit(False))


def raw_record_hash(fields: list[Column]) -> Column:
    """SHA-256 of the cleaned fields joined by bars; missing ones are empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.trim(f), F.lit("")) for f in fields]), 256)


def turbines(c: Column) -> Column:
    """'20' -> 20; '32 x 700 MW; 2 x 50 MW' -> 34; null if any part is not a count."""
    parts = F.transform(F.split(F.lower(c), ";"), lambda p: F.nullif(F.regexp_extract(p, r"^\s*(\d+)\s*(?:x.*)?$", 1), F.lit("")).try_cast("int"))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def slug(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("UNKNOWN"))


def compact_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def aliases(c: Column) -> Column:
    """A JSON list, or text split at the usual separators; trimmed, without empties."""
    parts = F.coalesce(F.from_json(c, "array<string>"), F.split(c, r"[;,/；、，|\n]"))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


# ---- numbers and units ------------------------------------------------------------------------

#: Energy units in GWh. Latin units must be equal, the Chinese ones may be part of the text; the first that fits counts.
ENERGY = {
    "亿千瓦时": 100.0, "亿度": 100.0, "万千瓦时": 0.01, "万度": 0.01, "度": 0.000001, "千瓦时": 0.000001, "兆瓦时": 0.001,
    "kwh": 0.000001, "mwh": 0.001, "gwh": 1.0, "twh": 1000.0,
}
#: Units of power, which are not energy.
POWER = ("kw", "mw", "gw", "千瓦", "兆瓦", "万千瓦")


def _unit(unit: Column, name: str) -> Column:
    return F.regexp_replace(F.lower(unit), r"\s", "") == name if name.isascii() else unit.contains(name)


def unit_factor(unit: Column) -> Column:
    """GWh of one unit; null for power and unclear units."""
    out = F.when(unit.isNull(), F.lit(None).cast("double"))
    for name, factor in ENERGY.items():
        out = out.when(_unit(unit, name), F.lit(factor))
    return out


def unit_kind(unit: Column) -> Column:
    power = reduce(Column.__or__, [_unit(unit, name) for name in POWER])
    return F.when(unit_factor(unit).isNotNull(), "energy").when(power, "power").otherwise("unclear")


def parse_number(raw: Column, decimal_comma: Column | None = None) -> Column:
    """Both separators: the last is decimal. Several of one kind, or a dot before three digits where commas are decimal: thousands.
    A single comma not followed by exactly three digits is decimal."""
    s = F.regexp_replace(raw, r"\s", "")
    dots, commas = F.length(s) - F.length(F.replace(s, F.lit("."), F.lit(""))), F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))
    no_dot, no_comma = F.replace(s, F.lit("."), F.lit("")), F.replace(s, F.lit(","), F.lit(""))
    local = F.coalesce(decimal_comma, F.lit(False)) if decimal_comma is not None else F.lit(False)
    text = (
        F.when((dots > 0) & (commas > 0), F.when(F.instr(F.reverse(s), ",") < F.instr(F.reverse(s), "."), F.replace(no_dot, F.lit(","), F.lit("."))).otherwise(no_comma))
        .when((dots > 1) | local & s.rlike(r"^\d{1,3}(\.\d{3})+$"), no_dot)
        .when((commas == 1) & ~s.rlike(r",\d{3}$"), F.replace(s, F.lit(","), F.lit(".")))
        .otherwise(no_comma)
    )
    return text.try_cast("double")


def capacity_ceiling(mw: Column) -> Column:
    """The most GWh of a year: full load all hours, and 15 % of slack."""
    return mw * 8760 / 1000 * 1.15


# ---- URLs -------------------------------------------------------------------------------------

#: Query keys that only track.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "referrer", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")


def _url(u: Column, group: int) -> Column:
    """1: scheme, 2: authority, 3: path, 4: query with its mark."""
    return F.regexp_extract(F.trim(u), r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", group)


def host(u: Column) -> Column:
    """Lower-case host of a URL, without user, port and the dot of the root."""
    return F.regexp_replace(F.regexp_replace(F.lower(_url(u, 2)), "^.*@", ""), r"(:\d*)?$", "")


def _form(text: Column) -> Column:
    """A part of a query, decoded and encoded anew."""
    coded = F.url_encode(F.coalesce(F.try_url_decode(text), text))
    return F.replace(F.replace(coded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_url(u: Column) -> Column:
    """Lower-case scheme and host, no user, no default port, single slashes, no trailing slash but the root's, no tracking keys, no
    fragment; query parts are encoded alike and keep their order. What is not http keeps all but its trailing slashes."""
    scheme, name = F.lower(_url(u, 1)), host(u)
    port = F.regexp_extract(_url(u, 2), r"(:\d+)$", 1)
    default = (scheme == "https") & (port == ":443") | (scheme == "http") & (port == ":80")
    slashes = F.regexp_replace(_url(u, 3), "/+", "/")
    path = F.when(slashes.isin("", "/"), "/").otherwise(F.regexp_replace(slashes, "/$", ""))
    parts = F.filter(F.split(F.regexp_replace(_url(u, 4), r"^\?", ""), "&"), lambda p: p != "")
    named = F.transform(parts, lambda p: F.struct(_form(F.substring_index(p, "=", 1)).alias("k"), _form(F.when(F.instr(p, "=") > 0, F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v")))
    kept = F.filter(named, lambda p: ~F.lower(p["k"]).isin(*TRACKING))
    query = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    whole = F.concat(scheme, F.lit("://"), name, F.when(default, "").otherwise(port), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme.isin("http", "https") & (name != ""), whole).otherwise(F.regexp_replace(F.trim(u), "/+$", ""))


def publisher_domain(u: Column) -> Column:
    """Host and port of the canonical URL, without www."""
    return F.regexp_replace(F.lower(_url(canonical_url(u), 2)), r"^www\.", "")


def doc_type(u: Column) -> Column:
    path = F.lower(_url(u, 3))
    out = F.when(path.endswith(".pdf"), "pdf").when(path.rlike(r"\.xlsx?$"), "excel").when(path.endswith(".csv"), "csv")
    return out.when(path.endswith(".json"), "json").otherwise("html")


def path_template(u: Column) -> Column:
    """The path with four-digit years as {year}; the bare root is null."""
    path = F.regexp_replace(_url(u, 3), r"(?<!\d)(?:19|20)\d{2}(?!\d)", "{year}")
    return F.nullif(F.nullif(path, F.lit("/")), F.lit(""))


#: Words that mark a link as official.
OFFICIAL = ("official", "operator", "owner", "官网", "官方", "运营商", "业主")


def link_class(u: Column, context: Column | None = None) -> Column:
    """kind and score of an outside link, by its host and the words around it."""
    name, words = F.regexp_replace(host(u), r"^www\.", ""), F.lower(F.coalesce(context, F.lit(""))) if context is not None else F.lit("")
    kind = lambda k, score: F.struct(F.lit(k).alias("kind"), F.lit(score).alias("score"))
    out = F.when(name.contains(".gov"), kind("authority", 0.95)).when(words.rlike("|".join(OFFICIAL)), kind("official", 0.92))
    return out.when(name.endswith(".org"), kind("reference", 0.72)).otherwise(kind("reference", 0.65))


# ---- first-match rules ------------------------------------------------------------------------

YEAR = r"(?<!\d)((?:19|20)\d{2})(?!\d)"


def find_years(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(YEAR), 1))


def _first(text: Column, rules: dict[str, str], default: str | None) -> Column:
    """The name of the first pattern that is found."""
    out = None
    for name, pattern in rules.items():
        hit = text.rlike(f"(?iU){pattern}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


#: Names of months; they may be cut to three letters.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS).replace("(?:)?", "")
#: What says which period a figure is about; the first that is found counts.
PERIOD = {
    "rolling_12_months": r"rolling\s*12\s*months?|trailing\s*12\s*months?|滚动\s*12\s*个?月",
    "ytd": r"\bytd\b|year[- ]to[- ]date|年初至今|截至.{0,12}(?:累计|发电)",
    "quarter": r"\bQ[1-4]\b|第?[一二三四1-4]季度",
    "fiscal_year": r"\bFY\s?\d{2,4}\b|财年|财政年度|fiscal\s+year|\b(?:19|20)\d{2}\s*[/–—-]\s*(?:19|20)\d{2}\b",
    "month": rf"(?:19|20)\d{{2}}[-/.年]\s*(?:0?[1-9]|1[0-2])\s*月?|\b(?:{MONTH})\b",
}
#: What names a metric.
METRIC = {
    "net_generation": r"净发电量|net\s+(?:electricity\s+)?generation",
    "energy_sent_out": r"上网电量|送出电量|energy\s+sent\s+out|electricity\s+supplied",
    "electricity_sales": r"售电量|electricity\s+sales|power\s+sales",
    "gross_generation": r"总发电量|毛发电量|完成发电量|gross\s+(?:electricity\s+)?generation|\b(?:annual\s+)?generation\b|\b(?:energia\s+)?gerad[ao]\b|\bgera[cç][aã]o\b|\bprodu[cç][aã]o\b|\bgeneraci[oó]n\b",
}
#: Words that tell forecasts from actual figures.
VALUE_TYPE = {
    "forecast": "forecast|projected|projection|estimate|estimated|expected|planned|target|预计|预测|计划|目标|拟",
    "actual": "actual|reported|recorded|achieved|实际|实发|累计完成|已完成|完成|达到|实现|atingiu|foi de|realizada|registrou|produziu",
}
#: Words that tell what a figure covers.
SCOPE = {
    "group": "group total|company total|集团合计|公司合计|全公司",
    "region": "total|aggregate|combined|basin|cascade|region|province|流域|梯级|合计|总计|全省|全区|区域",
    "complex": "complex|power base|电站群|基地|枢纽群",
    "plant": "station|plant|单站|本站|该电站|电站|usina|hidrelétrica|hidreletrica|hydroelectric",
}
#: Words for a whole year.
FULL_YEAR = r"全年|年度|全年度|annual(?:ly)?|anual(?:mente)?|full\s+year|calendar\s+year|yearly"


def period_type(text: Column) -> Column:
    return _first(text, PERIOD, "calendar_year")


def metric_clue(text: Column) -> Column:
    return _first(text, METRIC, "unknown")


def value_type_clue(text: Column) -> Column:
    """forecast or actual; null where no word says so."""
    return _first(text, VALUE_TYPE, None)


def scope_clue(text: Column) -> Column:
    """group, region, complex or plant; null where no word says so."""
    return _first(text, SCOPE, None)


def full_year_clue(text: Column) -> Column:
    return text.rlike(f"(?iU){FULL_YEAR}")


# ---- identifiers ------------------------------------------------------------------------------


def short_id(prefix: str, *parts: Column) -> Column:
    """prefix and 16 hex digits of the sha1 of the parts joined by ::; a null part is empty."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("::", *[F.coalesce(p, F.lit("")) for p in parts])), 1, 16))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and 20 hex digits of the sha256 of the trimmed parts joined by the unit separator; a null part is empty."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.trim(p), F.lit("")) for p in parts]), 256), 1, 20))


def task_id(entity: Column, kind: Column, period: Column, period_type: Column) -> Column:
    tail = F.when(period_type != "calendar_year", F.concat(F.lit("::"), period_type)).otherwise("")
    return F.concat_ws("::", entity, kind, F.concat(F.coalesce(period, F.lit("-")), tail))

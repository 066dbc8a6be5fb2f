"""Looking things up in the registry: filters, pages, names, links to make, and checks of rows to import."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wattline.functions import text as tx

# ---- filters and pages ------------------------------------------------------------------------


def _has(c: str, needle: str) -> Column:
    return F.coalesce(F.contains(F.lower(F.col(c)), F.lit(needle.lower())), F.lit(False))


def filtered(df: DataFrame, tests: list[Column]) -> DataFrame:
    return df.where(reduce(Column.__and__, tests)) if tests else df


def paged(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of df in a total order, each row with `total`: the number of all rows. The page is cut by Spark's top-k, the total is one row."""
    page = df.orderBy(*order).offset(offset).limit(limit)
    return page.crossJoin(df.agg(F.count("*").alias("total")))  # one row


def search_entities(df: DataFrame, q: str = "", country: str | None = None, status: str | None = None, least: float | None = None, most: float | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of entities by name, with the total: q in name, local name or aliases, without regard to case; country, status, capacity between least and most."""
    names = [c for c in ("canonical_name", "local_name", "aliases") if c in df.columns]
    tests = [reduce(Column.__or__, [_has(c, q) for c in names])] if q.strip() else []
    tests += [F.col(c) == v for c, v in (("country", country), ("status", status)) if v is not None]
    tests += [F.col("capacity_mw") >= least] if least is not None else []
    tests += [F.col("capacity_mw") <= most] if most is not None else []
    return paged(filtered(df, tests), ["canonical_name", "entity_id"], limit, offset)


def projects_by_status(projects: DataFrame, status: str | None = None, country: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Projects of a status, a country and years of commissioning, with their place by capacity, the largest first and unknown ones last."""
    tests = [F.col(c) == v for c, v in (("status", status), ("country", country)) if v is not None]
    tests += [F.col("commissioning_year") >= first] if first is not None else []
    tests += [F.col("commissioning_year") <= last] if last is not None else []
    return filtered(projects, tests).orderBy(F.desc_nulls_last("capacity_mw"), "entity_id")


def by_name(entities: DataFrame, name: str, fuzzy: bool = False) -> DataFrame:
    """Entities of that very name, or, fuzzily, with it in name or aliases."""
    return entities.where(_has("canonical_name", name) | _has("aliases", name) if fuzzy else F.col("canonical_name") == name)


def station_picker(stations: DataFrame, first: list[str], limit: int) -> DataFrame:
    """The first stations for a list to pick from: those of the countries in `first`, in their order, then others; the largest first; label: the local name, else the name, else the id."""
    home = reduce(lambda c, kv: c.when(F.col("country") == kv[1], kv[0]), enumerate(first), F.when(F.lit(False), 0)).otherwise(len(first))
    local = [F.nullif(F.trim(c), F.lit("")) for c in ("local_name", "canonical_name") if c in stations.columns]
    return stations.withColumn("label", F.coalesce(*local, F.col("entity_id"))).orderBy(home, F.desc_nulls_last("capacity_mw"), "canonical_name", "entity_id").limit(limit)


def auto_link(projects: DataFrame, stations: DataFrame, links: DataFrame) -> DataFrame:
    """project_id, station_id, effective_date of links to make: equal names, without regard to case and outer blanks, and equal years of commissioning; links that are there are left out."""
    own = lambda df, key: df.select(F.col("entity_id").alias(key), F.lower(F.trim("canonical_name")).alias("k"), "commissioning_year")
    new = own(projects, "project_id").join(own(stations, "station_id"), ["k", "commissioning_year"]).join(links, ["project_id", "station_id"], "left_anti")
    return new.select("project_id", "station_id", F.concat(F.col("commissioning_year").cast("string"), F.lit("-01-01")).alias("effective_date"))


# ---- rows to import ---------------------------------------------------------------------------


def check_import(rows: DataFrame, stations: DataFrame) -> DataFrame:
    """rows with `errors`: names of all rules that a row breaks, in order.

    rows: strings entity_id, period_label, period_type, value_type, measurement_scope, metric, generation_gwh, unit_raw, confidence. Required ones must not be blank; the year has four digits; only actual
    gross generation of a plant's calendar year is taken; the number is finite and not negative; the unit is one of energy; a confidence, if there is one, lies within 0 and 1; the entity is known.
    """
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    value, share = t("generation_gwh").try_cast("double"), t("confidence").try_cast("double")
    there = stations.select(F.col("entity_id").alias("__id")).distinct()
    required = ["entity_id", "period_label", "generation_gwh", "unit_raw"]
    rules = {f"no_{c}": t(c) == "" for c in required} | {
        "unknown_entity": (t("entity_id") != "") & F.col("__id").isNull(), "period_label": (t("period_label") != "") & ~t("period_label").rlike("^[0-9]{4}$"), "period_type": t("period_type") != "calendar_year",
        "value_type": F.lower(t("value_type")) != "actual", "measurement_scope": F.lower(t("measurement_scope")) != "plant", "metric": F.lower(t("metric")) != "gross_generation",
        "value": (t("generation_gwh") != "") & (value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | (value < 0)), "unit": (t("unit_raw") != "") & (tx.unit_kind(t("unit_raw")) != "energy"),
        "confidence": (t("confidence") != "") & (share.isNull() | ~share.between(0, 1)),
    }
    errors = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in rules.items()]))
    return rows.join(there, t("entity_id") == F.col("__id"), "left").withColumn("errors", errors).drop("__id")


# ---- whose figure it is -----------------------------------------------------------------------


def attribution(candidates: DataFrame, stations: DataFrame, sources: DataFrame, evidence: DataFrame, source_country, conflict) -> DataFrame:
    """candidates with `why` they cannot be about their entity: unknown_source, unknown_entity, source_country, text_country, or null; and `named`: whether the texts have the name's first three words.

    candidates: entity_id, source_id, evidence_id. sources: source_id, url, title, one row each; evidence: evidence_id, snippet, source_url. An address of the evidence that is another than the
    source's is looked at too. source_country(url) and conflict(country, home, text): column functions, as `discovery` has them.
    """
    e = evidence.select("evidence_id", "snippet", F.col("source_url").alias("evidence_url"))
    rows = candidates.join(sources.select("source_id", "url", "title"), "source_id", "left").join(e, "evidence_id", "left").join(stations.select("entity_id", "country", "canonical_name", F.lit(True).alias("__there")), "entity_id", "left")
    other = F.when(F.col("evidence_url") != F.col("url"), F.when(F.contains("evidence_url", F.lit("eia.gov")), "US"))
    home = F.coalesce(other, source_country(F.col("url")))
    text = F.concat_ws(" ", "title", "snippet")
    key = F.array_join(F.slice(F.split(F.trim("canonical_name"), r"\s+"), 1, 3), " ")
    why = F.when(F.col("url").isNull() & F.col("title").isNull(), "unknown_source").when(F.col("__there").isNull(), "unknown_entity").otherwise(conflict(F.col("country"), home, text))
    return rows.withColumns({"why": why, "named": F.contains(F.lower(text), F.lower(key))}).drop("__there", "url", "title", "snippet", "evidence_url", "country", "canonical_name")


def value_accuracy(expected: Column, actual: Column) -> Column:
    """How near a value is, from 1 to 0: 1 within 5 %, 0.9 within 10 %, 0.7 within 20 %, else what is left of 1 by the error; where 0 is expected, only 0 is right."""
    error = F.abs(expected - actual) / F.nullif(expected, F.lit(0.0))
    near = F.when(error <= 0.05, 1.0).when(error <= 0.1, 0.9).when(error <= 0.2, 0.7).when(error.isNotNull(), F.greatest(F.lit(0.0), 1 - error))
    return F.when(expected == 0, F.when(actual == 0, 1.0).otherwise(0.0)).otherwise(near)

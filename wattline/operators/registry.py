"""The registry of stations and projects from raw rows, and rules that add to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattline.functions import text as tx

#: States of what is or was a station.
BUILT = ("operating", "retired", "mothballed")
PRIORITY = {"A": 1, "B": 2, "C": 3, "D": 4}


def build_registry(raw: DataFrame) -> DataFrame:
    """Clean rows with type, tier, priority, review flag and hash. raw: strings name, status, capacity, country, unit, location, latitude, longitude, and `ordinal`, the row's number."""
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    status, capacity = F.lower(t("status")), t("capacity").try_cast("double")
    kind = F.when(status.isin(*BUILT), "station").when(status != "", "project").otherwise("unknown")
    tier = F.when(status != "operating", "D").when(capacity >= 1000, "A").when(capacity >= 300, "B").otherwise("C")
    within = lambda c, most: F.coalesce(t(c).try_cast("double"), F.lit(0.0)).between(-most, most)
    base = F.coalesce(F.nullif(t("unit"), F.lit("")), F.nullif(t("location"), F.lit("")), F.concat(F.lit("ROW-"), F.lpad(F.col("ordinal").cast("string"), 6, "0")))
    priority = F.coalesce(*[F.when(tier == k, F.lit(v)) for k, v in PRIORITY.items()])
    parts = [t(c) for c in ("location", "unit", "name", "capacity", "status", "country")]
    return raw.select(
        F.concat(F.lit("GEM-"), base).alias("entity_id"), kind.alias("entity_type"), tx.clean(F.col("name")).alias("canonical_name"), t("country").alias("country"), status.alias("status"), capacity.alias("capacity_mw"), tier.alias("priority_tier"),
        priority.alias("collection_priority"), (capacity.isNull() | ~within("latitude", 90) | ~within("longitude", 180)).alias("needs_review"), F.sha2(F.concat_ws("|", *parts, F.lit("")), 256).alias("raw_record_hash"),
        F.when(kind == "station", "not_started").otherwise("not_applicable").alias("generation_status"),
    )


def split_registry(built: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stations, projects)"""
    return built.where("entity_type = 'station'"), built.where("entity_type = 'project'")


def by_country(stations: DataFrame, rules: DataFrame, default: Column) -> DataFrame:
    """stations with the columns of the rule for their country, else the struct `default`. rules: country and the columns of default."""
    names = [c for c in rules.columns if c != "country"]
    joined = stations.join(rules, "country", "left")
    return joined.select(*stations.columns, *[F.coalesce(rules[c], default[c]).alias(c) for c in names])


def first_hint(stations: DataFrame, rules: DataFrame, key: str, name: str) -> DataFrame:
    """key, hint: of the rules (n, country, word, hint) for a station's country whose word is in its name, the first."""
    hits = stations.join(rules, "country").where(F.contains(F.col(name), F.col("word"))).groupBy(key).agg(F.min_by("hint", "n").alias("hint"))
    return stations.select(key).join(hits, key, "left")


MOST_PATHS, MOST_SITES = 12, 8  # templates of a publisher; sources and discoveries that tell where a station's data are


def publisher_profiles(sources: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, observations) of publishers, by domain and country, from official sources that have succeeded.

    A profile has the first name seen, the last language, the best reliability and success count, the last success, at most
    MOST_PATHS path templates in the order in which they were seen, and a search phrase. Observations: publisher_profile_id, source_id, entity_id, url.
    sources: source_id, entity_id, url, publisher, language, source_type, source_reliability_score, success_count, last_success.
    """
    rows = sources.where("source_type = 'official' and success_count > 0").join(stations.select("entity_id", F.coalesce("country", F.lit("")).alias("country")), "entity_id")
    rows = rows.withColumn("domain", tx.publisher_domain(F.col("url"))).where("domain <> ''")
    ident = F.concat(F.lit("publisher_"), F.substring(F.sha2(F.concat("domain", F.lit("\x1f"), F.lower("country")), 256), 1, 20))
    rows = rows.withColumns({"publisher_profile_id": ident, "path": tx.path_template(F.col("url")), "seen": F.struct("last_success", "source_id"), "lang": tx.clean(F.col("language"))})
    key = ["publisher_profile_id", "domain", "country"]
    out = rows.groupBy(*key).agg(
        F.min_by(F.coalesce(tx.clean(F.col("publisher")), "domain"), "seen").alias("canonical_name"), F.max_by("lang", F.when(F.col("lang").isNotNull(), F.col("seen"))).alias("language"),
        F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("source_reliability_score", F.lit(0.5))))).alias("reliability_score"), F.max("success_count").alias("success_count"), F.max("last_success").alias("last_success"),
    )
    paths = rows.where("path is not null").groupBy("publisher_profile_id", "path").agg(F.min("seen").alias("seen"))
    first = paths.withColumn("n", F.row_number().over(Window.partitionBy("publisher_profile_id").orderBy("seen", "path"))).where(F.col("n") <= MOST_PATHS)
    listed = first.groupBy("publisher_profile_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "path"))), lambda x: x["path"]).alias("report_paths"))
    out = out.join(listed, "publisher_profile_id", "left").withColumn("search_pattern", F.concat(F.lit("site:"), "domain", F.lit(" "), "canonical_name", F.lit(" {year} annual report")))
    return out, rows.select("publisher_profile_id", "source_id", "entity_id", "url")


def identity_profiles(stations: DataFrame, sources: DataFrame, discoveries: DataFrame, observations: DataFrame) -> DataFrame:
    """stations with official_domains, official_entry_urls (of the last MOST_SITES official sources that succeeded, then of the last accepted official
    discoveries, each once), publisher_profile_ids and the different names (aliases).

    sources: entity_id, source_id, url, source_type, success_count, last_success. discoveries: entity_id, url, source_type, status, updated_at."""

    def last(rows: DataFrame, when: str, rank: int) -> DataFrame:
        order = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc_nulls_last(when), "url"))
        return rows.select("entity_id", "url", when).withColumn("n", order).where(F.col("n") <= MOST_SITES).select("entity_id", F.struct(F.lit(rank).alias("r"), "n", "url").alias("x"))

    known = last(sources.where("source_type = 'official' and success_count > 0"), "last_success", 0).union(last(discoveries.where("source_type = 'official' and status = 'accepted'"), "updated_at", 1))
    urls = known.groupBy("entity_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["url"]).alias("urls"))
    ids = observations.groupBy("entity_id").agg(F.sort_array(F.collect_set("publisher_profile_id")).alias("publisher_profile_ids"))
    none = F.array().cast("array<string>")
    rows = stations.join(urls, "entity_id", "left").join(ids, "entity_id", "left").withColumn("urls", F.coalesce("urls", none))
    return rows.withColumns({
        "official_domains": F.array_distinct(F.filter(F.transform("urls", tx.publisher_domain), lambda d: d != "")), "official_entry_urls": F.array_distinct("urls"),
        "publisher_profile_ids": F.coalesce("publisher_profile_ids", none), "names": F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce(tx.aliases(F.col("aliases")), none))),
    }).drop("urls")


def known_report_urls(profiles: DataFrame, years: list[str]) -> DataFrame:
    """domain, year, url of reports that a publisher may have for other years: the paths of its known reports with the year put in.

    profiles: as publisher_profiles gives (domain, report_paths). A path may be a whole address; only addresses of the publisher's own domain
    or below it stay, each once.
    """
    rows = profiles.select("domain", F.explode("report_paths").alias("path")).where(F.trim("path") != "")
    each = rows.select("domain", "path", F.explode(F.array(*map(F.lit, years))).alias("year"))
    path = F.replace(F.trim("path"), F.lit("{year}"), F.col("year"))
    whole = F.when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), path).otherwise(F.concat(F.lit("https://"), "domain", F.when(path.startswith("/"), "").otherwise("/"), path))
    out = each.select("domain", "year", tx.canonical_url(whole).alias("url"))
    host = tx.publisher_domain(F.col("url"))
    return out.where((host == F.col("domain")) | F.endswith(host, F.concat(F.lit("."), "domain"))).distinct()

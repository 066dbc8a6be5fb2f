"""Sources found in several ways, as one row for each address."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattline.functions import text as tx

#: Ranks of kinds of sources and of ways of discovery.
KINDS = {"official": 3, "authority": 2, "reference": 1, "unknown": 0}
METHODS = {
    "sse_official_disclosure": 4, "deepseek_planned_web_search": 3, "deepseek_responses_web_search": 3,
    "official_site_explorer": 2, "gem_wiki_external_link": 2, "program_search_result": 1,
}
#: Fields that may hold a score, the first that does counts; aliases of an address.
SCORES = ["combined_score", "priority_score", "source_reliability_score", "estimated_reliability"]
ALIASES = 20
QUALITY = "struct<known:int,score:double,kind:int,method:int,reason:int>"


def first_score(columns: list[str]) -> Column:
    """The first number among the fields that may hold a score, within 0 and 1."""
    own = F.coalesce(*[F.col(c).try_cast("double") for c in SCORES if c in columns], F.lit(None).cast("double"))
    return F.when(own.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), own)))


def _rank(value: Column, ranks: dict[str, int]) -> Column:
    return reduce(lambda c, kv: c.when(value == kv[0], kv[1]), ranks.items(), F.when(F.lit(False), 0)).otherwise(0)


def _some(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def keyed(rows: DataFrame, prefer_final: bool = False) -> DataFrame:
    """rows with canonical: of final_url if that is preferred and is a web address, else of canonical_url or url. Rows without an address go."""
    text = lambda c: F.trim(F.col(c)) if c in rows.columns else F.lit(None).cast("string")
    plain = F.coalesce(F.nullif(text("canonical_url"), F.lit("")), text("url"))
    own = F.when(text("final_url").rlike("^https?://"), text("final_url")).otherwise(plain) if prefer_final else plain
    return rows.drop("canonical").withColumn("canonical", tx.canonical_url(own)).where(_some(F.col("canonical")))


def merge_sources(rows: DataFrame, prefer_final: bool = False) -> DataFrame:
    """One row for each address: canonical, url (of its first row), alias_urls, rows, score, publisher_domain, and every other column of rows.

    rows: url, rank and id (their order), and any of canonical_url, final_url, alias_urls (an array), the SCORES, source_type, discovery_method, match_reason and
    more. A row is better than those before it if a score is known, if that is greater, if kind, method or reason rank higher, in
    this order. The first row, and each that is better than all before it, lays its non-empty fields over what is
    there. Aliases are the addresses that lead to another canonical one, the first ALIASES in order.

    Which rows are better than all before is asked within runs of rows that are sorted by address and order and are dealt out in ranges, so an address
    of any number of rows is in many runs. A run yields its best quality and of each field the last value laid over; runs
    are put together in order, a field's value counting if its row is better than all earlier runs. Only a run's
    row is gathered for an address, never its rows or spellings.
    """
    fields = [c for c in rows.columns if c not in ("url", "rank", "id", "alias_urls", "canonical", *SCORES)]
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    score = first_score(rows.columns)
    quality = F.struct(
        score.isNotNull().cast("int").alias("known"), F.coalesce(score, F.lit(0.0)).alias("score"), _rank(F.lower(has("source_type")), KINDS).alias("kind"),
        _rank(has("discovery_method"), METHODS).alias("method"), _some(has("match_reason")).cast("int").alias("reason"),
    )
    all_rows = keyed(rows, prefer_final).withColumns({"score": score, "quality": quality, "place": F.struct("rank", "id")})
    fields = ["score", *[f for f in fields if f != "score"]]
    dealt = all_rows.repartitionByRange("canonical", "rank", "id").withColumn("run", F.spark_partition_id())
    before = F.max("quality").over(Window.partitionBy("canonical", "run").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, -1))
    better = dealt.withColumn("better", F.coalesce(F.col("quality") > before, F.lit(True)))
    laid = [F.max_by(F.struct(F.col("quality").alias("q"), F.col(f).alias("v")), F.when(F.col("better") & _some(F.col(f)), F.col("quality"))).alias(f"f_{f}") for f in fields]
    runs = better.groupBy("canonical", "run").agg(F.min("place").alias("place"), F.min_by("url", "place").alias("url"), F.max("quality").alias("q"), F.count("*").alias("n"), *laid)
    whole = runs.groupBy("canonical").agg(F.min_by("url", "place").alias("url"), F.sum("n").alias("rows"), F.sort_array(F.collect_list(F.struct("place", "q", *[f"f_{f}" for f in fields]))).alias("runs"))
    kinds = {f: runs.schema[f"f_{f}"].dataType["v"].dataType.simpleString() for f in fields}
    start = F.struct(F.expr(f"cast(null as {QUALITY})").alias("q"), *[F.expr(f"cast(null as {k})").alias(f) for f, k in kinds.items()])

    def over(was: Column, run: Column) -> Column:
        laid_over = [F.when(was["q"].isNull() | (run[f"f_{f}"]["q"] > was["q"]), F.coalesce(run[f"f_{f}"]["v"], was[f])).otherwise(was[f]).alias(f) for f in fields]
        return F.struct(F.greatest(was["q"], run["q"]).alias("q"), *laid_over)

    merged = whole.select("canonical", "url", "rows", F.aggregate("runs", start, over).alias("x")).select("canonical", "url", "rows", *[F.col(f"x.{f}").alias(f) for f in fields])
    out = merged.join(_aliases(all_rows), "canonical", "left").withColumn("publisher_domain", tx.publisher_domain(F.col("canonical")))
    return out.withColumn("alias_urls", F.coalesce("alias_urls", F.array().cast("array<string>")))


def _aliases(rows: DataFrame) -> DataFrame:
    """canonical, alias_urls: each alias at its first place; only the first ALIASES of an address are ever gathered."""
    given = [F.col("alias_urls")] if "alias_urls" in rows.columns else []
    own = F.array(*[F.trim(F.col(c)) for c in ("url", "canonical_url", "final_url") if c in rows.columns])
    known = F.transform(given[0], lambda a: F.struct(a.alias("a"), F.lit(True).alias("given"))) if given else F.array().cast("array<struct<a:string,given:boolean>>")
    each = F.concat(known, F.transform(own, lambda a: F.struct(a.alias("a"), F.lit(False).alias("given"))))
    seen = rows.select("canonical", "rank", "id", F.posexplode(F.coalesce(each, F.array().cast("array<struct<a:string,given:boolean>>"))).alias("at", "x"))
    other = seen.where(_some(F.col("x.a")) & (F.col("x.given") | (tx.canonical_url(F.col("x.a")) != F.col("canonical"))))
    first = other.groupBy("canonical", F.col("x.a").alias("alias")).agg(F.min(F.struct("rank", "id", "at")).alias("place"))
    few = first.withColumn("n", F.row_number().over(Window.partitionBy("canonical").orderBy("place"))).where(F.col("n") <= ALIASES)
    ordered = F.array_sort(F.collect_list(F.struct("n", "alias")))
    return few.groupBy("canonical").agg(F.transform(ordered, lambda x: x["alias"]).alias("alias_urls"))


def normalize_sources(rows: DataFrame, by: str | None = None) -> DataFrame:
    """The first row of each address (without regard to case and a closing slash; of each value of `by`), with score: the first known of SCORES within 0 and 1, else 0.

    First is the row of the greatest score, then of the least rank and id. It is found by an aggregate, so an address may have any number of rows.
    """
    score = F.coalesce(first_score(rows.columns), F.lit(0.0))
    whole = keyed(rows).withColumn("score", score)
    whole = whole.withColumn("key", F.lower(F.regexp_replace("canonical", "/+$", "")))
    keys = [*([by] if by else []), "key"]
    best = whole.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in whole.columns if c not in keys]), F.struct(-F.col("score"), F.col("rank"), F.col("id"))).alias("x"))
    return best.select(*keys, "x.*").drop("key")


def union_channels(channels: dict[str, DataFrame], top: int, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the `top` best sources of all channels, merged; the number of rows and of addresses of each channel).

    Each channel's rows are those of merge_sources, in the order of the channels. Sources are ordered by score, then address; `by`: a column, for each value of which `top` are taken.
    """
    tagged = [df.withColumns({"channel": F.lit(name), "rank": F.struct(F.lit(i).alias("channel"), F.col("rank").cast("long").alias("rank"))}) for i, (name, df) in enumerate(channels.items())]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    counts = keyed(both).groupBy("channel").agg(F.count("*").alias("n"), F.count_distinct("canonical").alias("distinct_urls"))
    merged = merge_sources(both)
    order = [F.desc_nulls_last("score"), F.asc("canonical")]
    if by is None:
        return merged.orderBy(*order).limit(top), counts
    return merged.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("n") <= top).drop("n"), counts

"""General frame operators: upserts, audits, counts, folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

Policy = Callable[[Column, Column, Column], Column]


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the rows of new whose key old lacks; the first of several new rows with a key is not chosen here."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policies: dict[str, Policy] | None = None) -> DataFrame:
    """Rows of both by key. A column of a row that is in both gets the new value, or what its policy(old, new, exists) says."""
    a = old.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in old.columns if c not in keys], F.lit(True).alias("__in_old"))
    b = new.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in old.columns if c not in keys], F.lit(True).alias("__in_new"))
    both = a.join(b, keys, "full")
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.col(c))
            continue
        was, now = F.col(f"__old_{c}"), F.col(f"__new_{c}")
        given = (policies or {}).get(c)
        merged = given(was, now, F.col("__in_old")) if given else now
        out.append(F.when(F.col("__in_new").isNull(), was).when(F.col("__in_old").isNull(), now).otherwise(merged).alias(c))
    return both.select(*out)


def keep_old(old: Column, new: Column, exists: Column) -> Column:
    return old


def first_known(old: Column, new: Column, exists: Column) -> Column:
    return F.coalesce(old, new)


def survives(*values: str) -> Policy:
    """The old value stays if it is one of these."""
    return lambda old, new, exists: F.when(old.isin(*values), old).otherwise(new)


def usage(parent: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """parent with the number of rows of each child; children are counted first, so joins do not multiply."""
    for name, child in children.items():
        counted = child.groupBy(key).agg(F.count("*").alias(name))
        parent = parent.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return parent


def assign_versions(docs: DataFrame) -> DataFrame:
    """url, content_hash, fetched_at -> one row for each (url, content_hash) with document_id and version by first fetch."""
    first = docs.groupBy("url", "content_hash").agg(F.min("fetched_at").alias("fetched_at"))
    ident = F.concat(F.lit("doc_"), F.substring(F.sha1(F.concat_ws("::", "url", "content_hash")), 1, 16))
    version = F.row_number().over(Window.partitionBy("url").orderBy("fetched_at", "content_hash"))
    return first.withColumns({"document_id": ident, "version": version.cast("long")})


def _then(f: Column, g: Column) -> Column:
    """The map s -> min(high, max(low, s + shift)) that applies f, then g; such maps compose to one of the same form."""
    clamp = lambda x: F.least(g["high"], F.greatest(g["low"], x + g["shift"]))
    return F.struct((f["shift"] + g["shift"]).alias("shift"), clamp(f["low"]).alias("low"), clamp(f["high"]).alias("high"))


def fold_reliability(events: DataFrame, key: str, order: list[str], ok: Column, initial: float = 0.5) -> DataFrame:
    """Per key, events in order: success adds 0.05, failure takes 0.10, always within 0 and 1.

    Each day of a key is folded to one map on its own, then the days' maps in order: no task holds more than a key's
    events of a day, or its days. order[0] is the time.
    """
    rows = events.select(key, *order, ok.alias("__wl_ok"), F.date_trunc("day", F.col(order[0])).alias("__wl_day"))
    same = F.struct(F.lit(0.0).alias("shift"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"))
    step = lambda good: F.struct(F.when(good, 0.05).otherwise(-0.10).alias("shift"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    day = F.aggregate(F.sort_array(F.collect_list(F.struct(*order, "__wl_ok"))), same, lambda f, x: _then(f, step(x["__wl_ok"])))
    days = rows.groupBy(key, "__wl_day").agg(day.alias("f"), F.count_if("__wl_ok").alias("good"), F.count_if(~F.col("__wl_ok")).alias("bad"), F.max(F.when(F.col("__wl_ok"), F.col(order[0]))).alias("last_good"), F.max(F.when(~F.col("__wl_ok"), F.col(order[0]))).alias("last_bad"))
    whole = F.aggregate(F.sort_array(F.collect_list(F.struct("__wl_day", "f"))), same, lambda f, x: _then(f, x["f"]))
    out = days.groupBy(key).agg(whole.alias("f"), F.sum("good").alias("success_count"), F.sum("bad").alias("failure_count"), F.max("last_good").alias("last_success"), F.max("last_bad").alias("last_failure"))
    score = F.least(F.col("f.high"), F.greatest(F.col("f.low"), F.lit(initial) + F.col("f.shift")))
    return out.select(key, score.alias("score"), "success_count", "failure_count", "last_success", "last_failure")


def generate_tasks(stations: DataFrame, projects: DataFrame, years: list[str], station_limit: int | None = None, project_limit: int | None = None) -> DataFrame:
    """Tasks of entities, the first by tier and priority if there is a limit: a station's generation of each year and its capacity, a project's status and commissioning."""
    order = ("priority_tier", "collection_priority", "entity_id")
    cut = lambda rows, n: rows if n is None else rows.orderBy(*[F.asc_nulls_first(c) for c in order]).limit(n)
    wanted = [("station", [*[("station_generation", y) for y in years], ("station_capacity", None)], cut(stations, station_limit)), ("project", [("project_status", None), ("project_commissioning", None)], cut(projects, project_limit))]
    out = []
    for entity_type, kinds, rows in wanted:
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("task_type"), F.lit(p).cast("string").alias("target_period")) for k, p in kinds]))
        out.append(rows.select("entity_id", "priority_tier", "collection_priority", each.alias("x")).select("entity_id", F.lit(entity_type).alias("entity_type"), "x.*", "priority_tier", "collection_priority"))
    tasks = out[0].unionByName(out[1])
    return tasks.withColumn("task_id", F.concat_ws("::", "entity_id", "task_type", F.coalesce("target_period", F.lit("-"))))


def status_updates(entities: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities with the status of their last update, the history: entity_id, old_status, new_status, seq of each update of a known entity).

    updates: entity_id, status, seq."""
    last = updates.groupBy("entity_id").agg(F.max_by("status", "seq").alias("__new"))
    now = entities.join(last, "entity_id", "left").withColumn("status", F.coalesce("__new", "status")).drop("__new")
    before = F.lag("status").over(Window.partitionBy("entity_id").orderBy("seq"))
    steps = updates.withColumn("__before", before).join(entities.select("entity_id", F.col("status").alias("__first")), "entity_id")
    return now, steps.select("entity_id", F.coalesce("__before", "__first").alias("old_status"), F.col("status").alias("new_status"), "seq")


#: Which task status may follow which.
TRANSITIONS = {
    "pending": ("running", "cancelled"),
    "running": ("success", "failed", "needs_review", "cancelled"),
    "failed": ("pending", "running", "cancelled"),
    "needs_review": ("success", "failed", "pending", "cancelled"),
    "success": (),
    "cancelled": (),
}


def illegal_transitions(history: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows whose status may not follow the one before; repeats of the same status are legal."""
    before = F.lag("status").over(Window.partitionBy(key).orderBy(*order))
    legal = F.map_from_arrays(F.array(*map(F.lit, TRANSITIONS)), F.array(*[F.array(*map(F.lit, v)) if v else F.array().cast("array<string>") for v in TRANSITIONS.values()]))
    return history.withColumn("before", before).where("before is not null and before <> status").where(~F.array_contains(F.element_at(legal, F.col("before")), F.col("status")))


def best_sources(sources: DataFrame, tasks: DataFrame, as_of: Column, k: int = 5, verified_only: bool = False) -> DataFrame:
    """Per task the k best sources of its entity and metric that did not just fail repeatedly.

    tasks: task_id, entity_id, metric, year. sources: entity_id, covered_metric, covered_year, source_reliability_score, success_count,
    failure_count, last_success, last_failure, source_id, url.
    """
    days = lambda c: F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(c)) / 86400)
    rows = tasks.join(sources.withColumnRenamed("covered_metric", "metric"), ["entity_id", "metric"]).where(F.col("covered_year").isNull() | (F.col("covered_year") == F.col("year")))
    rows = rows.where(~((F.col("failure_count") >= 3) & F.coalesce(days(F.col("last_failure")) < 7, F.lit(False))))
    if verified_only:
        rows = rows.where((F.col("success_count") > 0) & F.coalesce(days(F.col("last_success")) <= 90, F.lit(False)))
    order = [F.when(F.col("covered_year").isNotNull(), 0).otherwise(1), F.desc("source_reliability_score"), F.desc_nulls_last("last_success"), F.col("source_id"), F.col("url")]
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy(*order)).cast("long")
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)

"""From candidates to published facts: approvals bound to content, promotion, decisions of reviewers, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattline.functions import text as tx
from wattline.operators.archive import candidate_hash
from wattline.operators.extract import promotion_gates
from wattline.operators.trust import latest
from wattline.sources.files import written

FACT = ("entity_id", "fact_type", "fact_key")
NATURAL_KEY = ("entity_id", "period_type", "period_label", "value_type", "measurement_scope")


def approval_hashes(candidates: DataFrame, links: DataFrame, evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """candidate_id, candidate_hash: a hash of the candidate, its evidence and the documents' versions; and evidence_id, the first linked evidence that exists.

    The hash is null where a candidate has no evidence, or evidence is not that of its document's stored version: such a candidate cannot be approved.
    """
    hashed = candidate_hash(candidates, links, evidence, documents)
    return hashed.select("candidate_id", F.when(F.col("whole"), F.col("candidate_hash")).alias("candidate_hash"), "evidence_id")


def approval_reuse(reviews: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidate_id, review_id, reusable: the latest approval of each candidate's fact, which holds if it is of the same content.

    reviews: review_id, FACT, status, approved_hash, created_at. candidates: candidate_id, FACT, candidate_hash.
    """
    last = latest(reviews.where("status = 'approved'"), list(FACT), F.desc("created_at"), F.desc("review_id")).select(*FACT, "review_id", "approved_hash")
    both = candidates.join(last, list(FACT))
    return both.select("candidate_id", "review_id", F.coalesce(F.col("approved_hash") == F.col("candidate_hash"), F.lit(False)).alias("reusable"))


def approval_invalidate(reviews: DataFrame, candidates: DataFrame) -> DataFrame:
    """review_id of approvals with a hash that differs from that of a candidate for the same fact."""
    other = candidates.where("candidate_hash is not null").select(*FACT, "candidate_hash")
    approved = reviews.where("status = 'approved' and approved_hash is not null").select("review_id", *FACT, "approved_hash")
    return approved.join(other, list(FACT)).where("approved_hash <> candidate_hash").select("review_id").distinct()


def promotable(candidates: DataFrame, links: DataFrame, evidence: DataFrame, review_required: bool = True) -> DataFrame:
    """Validated candidates with `evidence_id` (the first linked one that exists) and `refused`: why not (missing fields, a blocking issue, failed gates), in order."""
    first = links.join(evidence.select("evidence_id"), "evidence_id", "left_semi").groupBy("candidate_id").agg(F.min("evidence_id").alias("evidence_id"))
    return refusals(candidates.join(first, "candidate_id", "left"), review_required)


def refusals(candidates: DataFrame, review_required: bool = True) -> DataFrame:
    """Validated candidates that have their `evidence_id` (null without), with has_evidence and `refused`, as `promotable` gives them."""
    rows = candidates.withColumn("has_evidence", F.col("evidence_id").isNotNull())
    needed = ("entity_id", "period_type", "period_label", "value_type", "measurement_scope", "generation_gwh")
    missing = [F.when(F.col(c).isNull(), F.lit(f"no_{c}")) for c in needed]
    why = F.array_compact(F.array(*missing, F.when(F.col("blocking"), F.lit("blocked"))))
    return rows.withColumn("refused", F.concat(why, F.transform(promotion_gates(review_required), lambda g: F.concat(F.lit("gate_"), g))))


def promote(records: DataFrame, candidates: DataFrame, as_of: Column, review_required: bool = True) -> DataFrame:
    """Facts by NATURAL_KEY after all candidates that nothing refuses are promoted; the latest of several for a key stays.

    candidates: as `promotable` gives. A fact that was there keeps created_at; all else is the candidate's. Other facts stay
    as they are; of several records of a key, which the key forbids, the latest is the fact.
    """
    key = list(NATURAL_KEY)
    good = latest(candidates.where(F.size("refused") == 0), key, F.desc("extracted_at"), F.desc("candidate_id"))
    new = good.select(
        *key, "generation_gwh", "metric", "normalized_unit", "candidate_id", "evidence_id", F.when(F.col("passed"), "passed").otherwise("passed_with_issues").alias("validation_status"),
        F.lit("approved" if review_required else "not_required").alias("review_status"), F.lit("publishable").alias("publication_status"), as_of.alias("updated_at"),
    )
    values = [c for c in new.columns if c not in key]
    old = latest(records, key, F.desc("created_at"), F.desc("id")).select(*key, *[F.col(c).alias(f"__{c}") for c in values], "created_at", F.lit(True).alias("__old"))
    both = old.join(new.withColumn("__new", F.lit(True)), key, "full")
    chosen = [F.when(F.col("__new"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in values]
    fate = F.when(F.col("__new") & F.col("__old"), "updated").when(F.col("__new"), "created").otherwise("kept")
    return both.select(*key, *chosen, F.coalesce("created_at", as_of).alias("created_at"), fate.alias("fate"))


DECISIONS = ("approve", "reject", "request_more_evidence", "cancel")


def judged(decisions: DataFrame, reviews: DataFrame, candidates: DataFrame) -> DataFrame:
    """decisions with the item, its task and `outcome`: applied, or why not.

    decisions: decision_id, review_id, decision, reviewer, reason, decided_at. reviews: review_id, candidate_id, entity_id, status, task_id,
    approved_hash. candidates: candidate_id, candidate_hash, refused (as `promotable` gives), period_label, value_type, evidence_id.
    An item is decided once, by the first known decision on it while it is open. An approval also needs the hash under which the item was
    queued to be the candidate's now (else the item is invalidated), and no reason to refuse promotion (then the item is decided, but nothing is published).
    """
    known = F.col("decision").isin(*DECISIONS)
    first = F.row_number().over(Window.partitionBy("review_id", known).orderBy("decided_at", "decision_id"))
    rows = decisions.withColumn("turn", first).join(reviews.select("review_id", "candidate_id", "entity_id", "status", "task_id", "approved_hash"), "review_id", "left")
    rows = rows.join(candidates.select("candidate_id", "candidate_hash", "refused", "period_label", "value_type", "evidence_id"), "candidate_id", "left")
    approve = F.col("decision") == "approve"
    outcome = (
        F.when(~known, "unknown_decision").when(F.col("status").isNull(), "no_item").when((F.col("status") != "open") | (F.col("turn") > 1), "not_open")
        .when(approve & F.col("approved_hash").isNull(), "no_hash").when(approve & ~F.coalesce(F.col("approved_hash") == F.col("candidate_hash"), F.lit(False)), "changed")
        .when(approve & (F.coalesce(F.size("refused"), F.lit(1)) > 0), "not_promotable").otherwise("applied")
    )
    return rows.withColumn("outcome", outcome).drop("turn", "status", "approved_hash", "candidate_hash", "refused")


def apply_decisions(decisions: DataFrame, reviews: DataFrame, candidates: DataFrame, judged_candidates: DataFrame, records: DataFrame, tasks: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """Everything that decisions change, from one table of verdicts that is stored once: verdicts, reviews, events, candidates, records, tasks.

    reviews and judged_candidates: as `judged` takes them; candidates, records and tasks: the tables that change.
    """
    verdicts = written(judged(decisions, reviews, judged_candidates), "verdicts")
    after = decided_reviews(verdicts, reviews)
    return {"verdicts": verdicts, "reviews": after, "events": decision_events(verdicts), "candidates": decided_candidates(verdicts, candidates), "records": decided_records(verdicts, records, as_of), "tasks": decided_tasks(verdicts, after, tasks)}


def decided_reviews(verdicts: DataFrame, reviews: DataFrame) -> DataFrame:
    """reviews with their new status: the decision (cancelled for cancel), invalidated where the candidate has changed."""
    done = verdicts.where("outcome in ('applied', 'not_promotable')").select("review_id", F.when(F.col("decision") == "cancel", "cancelled").otherwise(F.col("decision")).alias("__new"))
    void = verdicts.where("outcome = 'changed'").select("review_id", F.lit("invalidated").alias("__new"))
    return reviews.join(done.union(void), "review_id", "left").withColumn("status", F.coalesce("__new", "status")).drop("__new")


def decision_events(verdicts: DataFrame) -> DataFrame:
    """One event for each approval, rejection or cancellation that took effect."""
    rows = verdicts.where("outcome = 'applied' and decision in ('approve', 'reject', 'cancel')")
    cancelled = F.col("decision") == "cancel"
    return rows.select(tx.short_id("evt_", F.col("review_id"), F.col("decision")).alias("event_id"), "review_id", "candidate_id", F.when(cancelled, "cancel").otherwise("decide").alias("action"), F.when(~cancelled, F.col("decision")).alias("decision"), "reviewer", F.when(F.col("decision") != "approve", F.col("reason")).alias("reason"))


def decided_candidates(verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates with their new review_status."""
    status = F.when(F.col("decision") == "approve", "approved").when(F.col("decision") == "reject", "rejected").otherwise("pending")
    done = verdicts.where("outcome = 'applied' and decision in ('approve', 'reject', 'cancel')").groupBy("candidate_id").agg(F.max_by(status, F.struct("decided_at", "decision_id")).alias("__new"))
    return candidates.join(done, "candidate_id", "left").withColumn("review_status", F.coalesce("__new", "review_status")).drop("__new")


def decided_records(verdicts: DataFrame, records: DataFrame, as_of: Column) -> DataFrame:
    """records after the decisions on their entity, period and value type, in order.

    Approved: approved, validated, with the candidate's evidence. Rejected: withheld and rejected, if a draft or open
    for review. Cancelled: no review status.
    """
    effects = verdicts.where("outcome = 'applied' and decision in ('approve', 'reject', 'cancel')")
    key = ["entity_id", "period_label", "value_type"]
    steps = effects.groupBy("entity_id", "period_label", F.coalesce("value_type", F.lit("actual")).alias("value_type")).agg(F.sort_array(F.collect_list(F.struct("decided_at", "decision_id", "decision", "evidence_id"))).alias("__steps"))
    state = ("publication_status", "review_status", "validation_status", "evidence_id")
    start = F.struct(*[F.nullif(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in state], F.lit(False).alias("touched"))  # a type that may be null

    def step(now: Column, d: Column) -> Column:
        approve, cancel = d["decision"] == "approve", d["decision"] == "cancel"
        reject = (d["decision"] == "reject") & ((now["publication_status"] == "draft") | F.coalesce(now["review_status"] == "open", F.lit(False)))
        return F.struct(
            F.when(reject, "withheld").otherwise(now["publication_status"]).alias("publication_status"),
            F.when(approve, "approved").when(reject, "rejected").when(~cancel, now["review_status"]).alias("review_status"),
            F.when(approve, "validated").otherwise(now["validation_status"]).alias("validation_status"),
            F.when(approve, d["evidence_id"]).otherwise(now["evidence_id"]).alias("evidence_id"),
            (now["touched"] | approve | reject | cancel).alias("touched"),
        )

    rows = records.join(steps, key, "left").withColumn("__now", F.aggregate(F.coalesce("__steps", F.expr("cast(array() as array<struct<decided_at:timestamp,decision_id:bigint,decision:string,evidence_id:string>>)")), start, step))
    return rows.withColumns({c: F.col(f"__now.{c}") for c in state} | {"updated_at": F.when(F.col("__now.touched"), as_of).otherwise(F.col("updated_at"))}).drop("__steps", "__now")


def decided_tasks(verdicts: DataFrame, reviews_after: DataFrame, tasks: DataFrame) -> DataFrame:
    """tasks with their new status: failed after a decision that could not be carried out; else, once no item of it is open, success
    or failed as the last approval or rejection says. Terminal tasks stay."""
    still = reviews_after.where("status = 'open'").select("task_id").distinct().withColumn("__open", F.lit(True))
    when = F.struct("decided_at", "decision_id")
    broken = F.col("outcome").isin("no_hash", "changed", "not_promotable")
    final = F.when((F.col("outcome") == "applied") & F.col("decision").isin("approve", "reject"), F.col("decision"))
    last = verdicts.where("task_id is not null").groupBy("task_id").agg(F.max(broken).alias("__broken"), F.max_by(final, F.when(final.isNotNull(), when)).alias("__last"))
    rows = tasks.join(last, "task_id", "left").join(still, "task_id", "left")
    closed = F.col("__open").isNull() & F.col("__last").isNotNull()
    new = F.when(F.col("status").isin("success", "cancelled"), F.col("status")).when(F.col("__broken"), "failed").when(closed, F.when(F.col("__last") == "approve", "success").otherwise("failed")).otherwise(F.col("status"))
    return rows.withColumn("status", new).drop("__broken", "__last", "__open")


#: Units that an import may use.
IMPORT_UNITS = ("gwh", "mwh", "twh", "kwh", "亿千瓦时", "万千瓦时", "千瓦时")


def import_candidates(rows: DataFrame, stations: DataFrame, document_id: Column) -> DataFrame:
    """rows with `error` (null if accepted), candidate_id, evidence_id, review task and snippet of the candidate that each makes.

    rows: row (its number), and strings entity_id, period_label, period_type, metric, generation_gwh, unit_raw, value_type,
    measurement_scope, confidence, canonical_name. The first rule that a row breaks is its error. Equal rows of one document
    have ids of their own, and the same file gives the same ids again.
    """
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    value = t("generation_gwh").try_cast("double")
    share = F.nullif(t("confidence"), F.lit("")).try_cast("double")
    known = stations.select(F.col("entity_id").alias("__id"), F.col("canonical_name").alias("__name"))
    rules = [
        ("empty", (t("entity_id") == "") | (t("period_label") == "") | (t("generation_gwh") == "")),
        ("period_label", ~t("period_label").rlike("^[0-9]{4}$")),
        ("period_type", t("period_type") != "calendar_year"),
        ("value_type", F.lower(t("value_type")) != "actual"),
        ("measurement_scope", F.lower(t("measurement_scope")) != "plant"),
        ("metric", F.lower(t("metric")) != "gross_generation"),
        ("generation_gwh", value.isNull() | F.isnan(value) | (value < 0) | (value == float("inf"))),
        ("unknown_entity", F.col("__id").isNull()),
        ("unit_raw", ~F.lower(t("unit_raw")).isin(*IMPORT_UNITS)),
        ("confidence", (t("confidence") != "") & (share.isNull() | ~share.between(0, 1))),
    ]
    error = F.coalesce(*[F.when(test, F.lit(code)) for code, test in rules])
    joined = rows.join(known, t("entity_id") == F.col("__id"), "left").withColumn("error", error)
    good = F.col("error").isNull()
    ident = F.concat(F.lit("cand_"), F.substring(F.sha2(F.concat_ws("|", document_id, F.col("row").cast("string"), *[t(c) for c in ("entity_id", "period_label", "generation_gwh", "unit_raw")]), 256), 1, 24))
    out = joined.withColumns({"document_id": document_id, "candidate_id": F.when(good, ident)})
    evidence = F.concat(F.lit("evi_"), F.substring(F.sha2(F.concat_ws(":", "document_id", "candidate_id"), 256), 1, 24))
    task = F.concat(F.lit("manual_review::"), F.substring(F.sha2("candidate_id", 256), 1, 16))
    renamed = (t("canonical_name") != "") & (t("canonical_name") != F.col("__name"))
    return out.withColumns({
        "evidence_id": F.when(good, evidence), "task_id": F.when(good, task),
        "snippet": F.when(good, F.concat(F.lit("CSV row "), F.col("row").cast("string"), F.lit(": "), t("entity_id"), F.lit(", "), t("period_label"), F.lit(", "), t("generation_gwh"), F.lit(" "), t("unit_raw"))),
        # every import is reviewed; another name than the registry's is an issue of its own
        "review_reason": F.when(good, F.concat_ws("; ", F.lit("CSV_IMPORT_REVIEW"), F.when(renamed, "ENTITY_AMBIGUOUS"))),
    }).drop("__id", "__name")


def import_counts(imported: DataFrame, existing: DataFrame) -> DataFrame:
    """read, imported, existing (their candidate is there already), skipped."""
    there = existing.select("candidate_id").distinct().withColumn("__there", F.lit(True))
    rows = imported.join(there, "candidate_id", "left")
    good = F.col("error").isNull()
    return rows.agg(F.count("*").alias("read"), F.count_if(good & F.col("__there").isNull()).alias("imported"), F.count_if(good & F.col("__there").isNotNull()).alias("existing"), F.count_if(~good).alias("skipped"))

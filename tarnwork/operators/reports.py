"""Stored reviews: latest by key, sides of a pair, what is still to review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import identity
from . import verdicts as V


def latest(reports: DataFrame, *key: str, order: tuple[str, ...] = ("completed_at", "review_key")) -> DataFrame:
    """The last report of each key; a max_by, combined before the shuffle."""
    row = F.max_by(F.struct(*(c for c in reports.columns if c not in key)), F.struct(*order))
    return reports.groupBy(*key).agg(row.alias("_r")).select(*key, "_r.*")


def state(decision, conclusive):
    return F.when((decision == "inconclusive") | ~F.coalesce(conclusive, F.lit(True)), "inconclusive").otherwise("completed")


def compliant(decision):
    return F.when(decision == "compliant", True).when(decision == "violation", False)


def both_sides(pairs: DataFrame) -> DataFrame:
    """A row for each side of a pair report, as its subject, with the evidence's paths turned round for the second."""
    swap = F.transform("evidence", lambda e: F.struct(e["second_path"].alias("submission_path"), e["first_path"].alias("counterpart_path"), e["description"].alias("description")))
    keep = F.transform("evidence", lambda e: F.struct(e["first_path"].alias("submission_path"), e["second_path"].alias("counterpart_path"), e["description"].alias("description")))
    side = lambda a, b, e: F.struct(F.col(a).alias("submission_id"), F.col(b).alias("counterpart_id"), e.alias("evidence"))
    rest = [c for c in pairs.columns if c not in ("first_id", "second_id", "evidence")]
    return pairs.select(*rest, F.explode(F.array(side("first_id", "second_id", keep), side("second_id", "first_id", swap))).alias("_s")).select(*rest, "_s.*")


def valid_pairs(reports: DataFrame) -> DataFrame:
    """Stored pair reports that hold together."""
    return reports.filter(
        (F.col("review_key") == F.col("task_key")) & F.col("review_key").rlike(r"^[0-9a-f]{64}\z") & F.col("confidence").between(0, 1) & F.col("jaccard").between(0, 1)
        & (F.col("human_review_status") == "pending") & (F.col("conclusive") == (F.col("decision") != "inconclusive")) & (F.col("first_id") != F.col("second_id"))
    )


def pending(candidates: DataFrame, reports: DataFrame, basis: dict[str, str], models: list[str]) -> DataFrame:
    """Candidates without a current compliant report: same versions as asked for, by an allowed model."""
    now = (F.col("state") == "completed") & (F.col("decision") == "compliant") & F.col("model").isin(*models)
    for name, value in basis.items():
        now = now & (F.col(name) == value)
    return candidates.join(reports.filter(now).select("submission_id"), candidates["id"] == F.col("submission_id"), "left_anti")


def skip_summary(candidates: DataFrame, todo: DataFrame, failures: DataFrame) -> DataFrame:
    n = candidates.agg(F.count("*").alias("candidate_count"))
    t = todo.join(failures, "id", "left").agg(F.count("*").alias("_t"), F.count("error").alias("failed_count"), F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.col("id")))).alias("failed_ids"))
    return n.join(t).select("candidate_count", (F.col("candidate_count") - F.col("_t")).alias("skipped_count"), (F.col("_t") - F.col("failed_count")).alias("reviewed_count"), "failed_count", "failed_ids")


def with_ledger(tasks: DataFrame, ledger: DataFrame, kind: str) -> DataFrame:
    """Tasks with the stored verdict that may be used again, if there is one. A ledger with identities is read with a
    check of each against its key, and fails where they do not agree."""
    if "identity" in ledger.columns:
        ledger = identity.checked(ledger)
    stored = ledger.filter(V.reusable(kind)).select("review_key", F.col("decision").alias("stored_decision"), F.col("confidence").alias("stored_confidence"))
    return tasks.join(stored, "review_key", "left").withColumn("cache_hit", F.col("stored_decision").isNotNull())


def run_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("tasks"), F.count_if("cache_hit").alias("cache_hits"), F.count_if(~F.col("cache_hit") & F.col("error").isNull()).alias("model_calls"), F.count_if(F.col("error").isNull() & (F.col("decision") != "inconclusive")).alias("completed"),
        F.count_if(F.col("error").isNull() & (F.col("decision") == "inconclusive")).alias("inconclusive"), F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def requested(ids: DataFrame, found: DataFrame) -> DataFrame:
    """Of the ids asked for (ord, submission_id), those found, in the order asked."""
    return ids.join(found, "submission_id").orderBy("ord")


def preferred(agent: DataFrame, files: DataFrame) -> DataFrame:
    """The agent's completed report, else the stored one."""
    cols = [c for c in agent.columns if c != "submission_id"]
    a = agent.select("submission_id", F.struct(*cols).alias("_a"))
    b = files.select("submission_id", F.struct(*cols).alias("_b"))
    met = a.join(b, "submission_id", "full")
    return met.select("submission_id", F.when(F.col("_a").isNotNull(), "agent").otherwise("stored").alias("origin"), *(F.when(F.col("_a").isNotNull(), F.col(f"_a.{c}")).otherwise(F.col(f"_b.{c}")).alias(c) for c in cols))


def pair_task_key(first, second, *parts):
    """Content-addressed key of a pair task; the order of the two does not matter."""
    return F.sha2(F.concat_ws("\0", F.least(first, second), F.greatest(first, second), *parts), 256)


def in_order(tasks: DataFrame) -> DataFrame:
    """Tasks by kind, lab and key, as they are handed out."""
    return tasks.orderBy("kind", "lab_id", "task_key")

"""Review runs from their append-only events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# States and error codes of runs.
STATES = ("queued", "preparing", "running", "finalizing", "completed", "failed", "cancelled")
TERMINAL = ("completed", "failed", "cancelled")
ACTIVE = ("preparing", "running", "finalizing")
RETRYABLE = ("JOB_LOST", "MODEL_UNAVAILABLE")
MANUAL_RETRYABLE = ("AGENT_EXECUTION_FAILED", "RESULT_INVALID")
MAX_ATTEMPTS = 3
# Where a run may go from each state. A failed one is queued again; each active one may fail.
NEXT = {
    "queued": ("preparing", "failed", "cancelled"), "preparing": ("running", "failed", "cancelled"), "running": ("finalizing", "failed", "cancelled"),
    "finalizing": ("completed", "failed"), "failed": ("queued",), "completed": (), "cancelled": (),
}


def sequenced(events: DataFrame, *arrival: str) -> DataFrame:
    """Events with their number in the run, from 1."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy("run_id").orderBy(*arrival)))


def current(events: DataFrame, attempt_state: str = "preparing") -> DataFrame:
    """run_id, state, updated_at, error_code, sequence, attempts."""
    last = F.max_by(F.struct("state", "updated_at", "error_code", "sequence"), "sequence")
    return events.groupBy("run_id").agg(last.alias("_e"), F.count_if(F.col("state") == attempt_state).alias("attempts")).select("run_id", "_e.*", "attempts")


def latest_by_submission(runs: DataFrame) -> DataFrame:
    row = F.max_by(F.struct(*(c for c in runs.columns if c != "submission_id")), F.struct("created_at", "run_id"))
    return runs.groupBy("submission_id").agg(row.alias("_r")).select("submission_id", "_r.*")


def retryable(manual: bool = True):
    out = F.col("error_code").isin(*RETRYABLE)
    return F.coalesce(out | ((F.col("source") == "manual") & F.col("error_code").isin(*MANUAL_RETRYABLE)) if manual else out, F.lit(False))


def public(runs: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    return runs.withColumn("max_attempts", F.lit(most)).withColumn("will_retry", (F.col("state") == "failed") & (F.col("attempts") < most) & retryable())


def reconcile(runs: DataFrame, batch: int, newest_first: bool, most: int = MAX_ATTEMPTS) -> DataFrame:
    """The failed runs to queue again; those out of attempts don't count against the batch."""
    due = runs.filter((F.col("state") == "failed") & retryable(newest_first) & (F.col("attempts") < most))
    order = [F.col("updated_at"), F.col("run_id")]
    return due.orderBy(*(c.desc() if newest_first else c.asc() for c in order)).limit(batch)


def recover(runs: DataFrame, results: DataFrame) -> DataFrame:
    """run_id, state, error_code after a restart: results that were written complete their run, other active runs are lost."""
    met = runs.join(results.select("run_id", F.lit(True).alias("_has")), "run_id", "left")
    done = (F.col("state") == "finalizing") & F.col("_has")
    lost = F.col("state").isin(*ACTIVE)
    return met.select("run_id", F.when(done, "completed").when(lost, "failed").otherwise(F.col("state")).alias("state"), F.when(F.coalesce(done, F.lit(False)), None).when(lost, "JOB_LOST").otherwise(F.col("error_code")).alias("error_code"))


def ready_only(runs: DataFrame, markers: DataFrame) -> DataFrame:
    """Runs with a ready marker and a well-formed id."""
    return runs.filter(F.col("run_id").rlike(r"^(?:review|plagiarism)-[0-9a-f]{64}\z")).join(markers, "run_id", "left_semi")


def broken_transitions(events: DataFrame, following: dict[str, tuple[str, ...]] = NEXT) -> DataFrame:
    """run_id, sequence, before, state of the events that their run's last state does not allow; a run opens queued."""
    before = F.lag("state").over(Window.partitionBy("run_id").orderBy("sequence"))
    allowed = F.when(F.col("before").isNull(), F.col("state") == "queued").otherwise(F.lit(False))
    for state, after in following.items():
        allowed = allowed | (F.col("before").eqNullSafe(F.lit(state)) & F.col("state").isin(*after))
    return events.select("run_id", "sequence", before.alias("before"), "state").filter(~allowed)


def admit(requests: DataFrame, existing: DataFrame, models: list[str], room: int | None = None) -> DataFrame:
    """New requests by payload digest, of allowed models, with whether there is room; a known payload is its existing run.

    requests: payload, model, created_at. Of one payload the earliest counts. The first by time are admitted, as many as
    there is room for; top-k by sort and limit, so that no task sees them all.
    """
    keyed = requests.filter(F.col("model").isin(*models)).withColumn("run_id", F.concat(F.lit("review-"), F.sha2(F.col("payload").cast("binary"), 256)))
    first = keyed.groupBy("run_id").agg(F.min_by(F.struct("payload", "model", "created_at"), "created_at").alias("_r")).select("run_id", "_r.*")
    fresh = first.join(existing.select("run_id"), "run_id", "left_anti")
    if room is None:
        return fresh.withColumn("admitted", F.lit(True))
    taken = fresh.orderBy("created_at", "run_id").limit(max(0, room)).select("run_id", F.lit(True).alias("_in"))
    return fresh.join(taken, "run_id", "left").withColumn("admitted", F.coalesce("_in", F.lit(False))).drop("_in")

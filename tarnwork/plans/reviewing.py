"""Reviewers over tasks: calls in batches, transient failures tried again, finished runs left as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks, versions
from ..operators import similarity, target_index
from ..storage import staged
from .audit import Reviewer

MOST_ATTEMPTS = 2
ATTEMPT = "task_key string, decision string, confidence double, failure string, error string"


class Transient(RuntimeError):
    """A failure that may pass: the task is tried again, as long as it has attempts left."""


class Final(RuntimeError):
    """A failure that would come again."""


def _calls(tasks: DataFrame, answer: Callable[[dict], dict]) -> DataFrame:
    """ATTEMPT of one call for each task. What answer raises is the row's failure; other exceptions are final ones."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for task in part.to_dict("records"):
                try:
                    got = answer(task)
                    rows.append((task["task_key"], got["decision"], float(got["confidence"]), None, None))
                except Transient as e:
                    rows.append((task["task_key"], None, None, "transient", str(e)))
                except Exception as e:
                    rows.append((task["task_key"], None, None, "final", f"{type(e).__name__}: {e}" if not isinstance(e, Final) else str(e)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ATTEMPT.split(", ")])

    return tasks.mapInPandas(run, ATTEMPT)


def attempts(tasks: DataFrame, answer: Callable[[dict], dict], most: int = MOST_ATTEMPTS) -> DataFrame:
    """ATTEMPT and attempt (from 1) of every call. A round's calls are a written table: what is read again is not called
    again, and when a task of Spark's is lost only its own calls are made anew. Only transient failures go to the next round."""
    found, left = None, tasks
    for attempt in range(1, most + 1):
        made = staged(_calls(left, answer).withColumn("attempt", F.lit(attempt)), "review-attempts")
        found = made if found is None else found.unionByName(made)
        again = made.filter("failure = 'transient'").select("task_key")
        if attempt == most or again.isEmpty():
            break
        left = tasks.join(again, "task_key", "left_semi")
    return found


def caller(answer: Callable[[dict], dict], most: int = MOST_ATTEMPTS, keep: Callable[[DataFrame], None] | None = None) -> Reviewer:
    """A reviewer that calls answer(task) -> decision, confidence. keep gets the record of all attempts. A task whose last
    attempt failed has that attempt's error."""

    def review(tasks: DataFrame) -> DataFrame:
        every = attempts(tasks, answer, most)
        if keep is not None:
            keep(every)
        last = F.max_by(F.struct("decision", "confidence", "error"), "attempt")
        return every.groupBy("task_key").agg(last.alias("_r"), F.count("*").alias("attempts")).select("task_key", "_r.*", "attempts")

    return review


def finished(spark: SparkSession, folder: str) -> DataFrame | None:
    """The clean summary of a run, if there is one: a finished run is not done again."""
    return sinks.stored(spark, f"{folder}/summary") if versions.current(spark, f"{folder}/summary").parts else None


def once(spark: SparkSession, folder: str, run: Callable[[], DataFrame]) -> DataFrame:
    """The summary of a run: the stored one if it is clean, else what run gives, stored as the run's or one of its attempts'."""
    known = finished(spark, folder)
    if known is not None:
        return known.drop("summary_key")
    summary = staged(run(), "run-summary")
    sinks.write_summary(summary, folder)
    return summary


def target_candidates(index: str, target: DataFrame, threshold: float = similarity.THRESHOLD, most: int = similarity.MOST_CANDIDATES) -> DataFrame:
    """A target's candidates from the index, in order; too many for one review are an error, none is cut."""
    found = staged(target_index.probe(index, target, threshold), "target-candidates")
    return similarity.in_order(similarity.within_cap(found, most))

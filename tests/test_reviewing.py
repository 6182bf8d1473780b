"""Reviewers that call: attempts, failures that pass and that stay, finished runs, caps on one target's candidates."""

import os

import pytest

from tarnwork import sinks
from tarnwork.plans import reviewing

from .test_target_index import corpus, entities


def test_transient_failures_are_tried_again(spark, tmp_path):
    """What a call does the first and the second time is told by files, which outlive workers."""
    calls = str(tmp_path)

    def answer(task):
        n = len([x for x in os.listdir(calls) if x.startswith(task["task_key"] + ".")])
        open(f"{calls}/{task['task_key']}.{n}", "x").close()
        kind = task["kind"]
        if kind == "passes" and n == 0 or kind == "stays":
            raise reviewing.Transient(f"busy {n}")
        if kind == "final":
            raise reviewing.Final("no such lab")
        if kind == "odd":
            return {"decision": "compliant"}
        return {"decision": "compliant", "confidence": 0.5}

    tasks = spark.createDataFrame([(f"k{i}", kind) for i, kind in enumerate(["good", "passes", "stays", "final", "odd"] * 3)], "task_key string, kind string")
    kept = []
    out = reviewing.caller(answer, keep=kept.append)(tasks).join(tasks, "task_key")
    got = {(r["kind"], r["decision"], r["error"], r["attempts"]) for r in out.collect()}
    assert got == {("good", "compliant", None, 1), ("passes", "compliant", None, 2), ("stays", None, "busy 1", 2), ("final", None, "no such lab", 1), ("odd", None, "KeyError: 'confidence'", 1)}
    assert out.count() == 15 and kept[0].count() == 21 == len(os.listdir(calls))  # reading again called nothing again


def test_a_finished_run_is_not_done_again(spark, tmp_path):
    done = []

    def run(failed):
        done.append(failed)
        return spark.createDataFrame([(3, failed)], "tasks int, failed int")

    folder = str(tmp_path)
    assert reviewing.finished(spark, folder) is None
    for failed in (2, 1, 0, 5):
        got = reviewing.once(spark, folder, lambda failed=failed: run(failed)).first()
    assert done == [2, 1, 0] and (got["tasks"], got["failed"]) == (3, 0)
    assert sinks.stored(spark, f"{folder}/attempt_summaries").count() == 2


def test_candidates_over_the_cap_are_an_error(spark, tmp_path):
    df, path = entities(spark, corpus(5, 40)), str(tmp_path)
    reviewing.target_index.add(df, path, "all", threshold=0.2)
    target = df.filter("not incomplete and size(shingles) > 0").orderBy("id").limit(1)
    n = reviewing.target_candidates(path, target, 0.2).count()
    assert n > 1
    with pytest.raises(ValueError):
        reviewing.target_candidates(path, target, 0.2, most=n - 1)

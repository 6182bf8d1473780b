"""Deltas and budgets at size: texts are not dealt by lab, workers hold a few files, keys are not groups of their own."""

import random

from pyspark.sql import functions as F

from tarnwork.operators import delta, evidence

FILE = "submission_id bigint, lab_id string, path string, content string, omission_reason string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some(spark):
    base = spark.createDataFrame([("l", "a", "1\n2\n3\n", "r", "course")], "lab_id string, path string, content string, revision string, kind string")
    return spark.createDataFrame([(i, "l", "a", f"1\n{i}\n3\n", None) for i in range(200)] + [(200, "m", "a", "x\n", None)], FILE), base


def test_files_of_a_hot_lab_are_not_dealt_by_it(spark, monkeypatch):
    files, base = some(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = delta.against_baseline(files, base)
        assert "BroadcastHashJoin" in plan(got) and "SortMergeJoin" not in plan(got)
        monkeypatch.setattr(delta, "BROADCAST", 0)  # a larger baseline
        large = delta.against_baseline(files, base)
        assert "BroadcastHashJoin" not in plan(large)
        assert sorted(map(tuple, large.collect()), key=str) == sorted(map(tuple, got.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_worker_compares_a_few_files_at_a_time(spark):
    files, base = some(spark)
    got = delta.build(files.coalesce(1), base)
    assert "MapInArrow" in plan(got) and "ArrowEvalPython" not in plan(got)
    rows = {r["submission_id"]: r["_c"] for r in delta.build(files.coalesce(1), base).select("submission_id", F.struct("added_text", "removed_text", "hunks").alias("_c")).collect()}
    assert set(rows) == set(range(201)) - {2}
    for i in rows:
        assert rows[i].asDict(True) == delta.compare("" if i == 200 else "1\n2\n3\n", "x\n" if i == 200 else f"1\n{i}\n3\n")


def test_budgets_take_many_keys_at_once(spark):
    rng = random.Random(5)
    rows = [(k, f"{k}/{i}", rng.randint(0, 90), rng.choice([1, 2, 4]), 20 + k) for k in range(40) for i in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "key int, path string, size bigint, priority int, most bigint")
    got = evidence.budgets(df, "key", "most")
    assert "FlatMapGroupsInPandas" not in plan(got) and got.columns == ["key", "path", "size", "priority", "budget"]
    want = []
    for k in range(40):
        mine = [r for r in rows if r[0] == k]
        shares = evidence.allocate([r[2] for r in mine], [r[3] for r in mine], [r[1] for r in mine], 20 + k)
        want += [(*r[:4], b) for r, b in zip(mine, shares)]
    assert sorted(map(tuple, got.collect())) == sorted(want)

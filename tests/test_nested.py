"""Values nested to any depth, and what spans cover together."""

import json
import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwork.operators import evidence, nested


def test_marks_at_any_depth(spark):
    deep = {"truncated": True}
    for i in range(40):
        deep = {"a": [i, deep]} if i % 2 else {"b": deep, "truncated": False}
    cases = [
        ({}, False), ({"truncated": False}, False), ({"truncated": "true"}, False), ({"truncated": 1}, False), ({"input_truncated": True}, True), ({"x": [{"y": [{"omitted_file_count": 2}]}]}, True),
        ({"omitted_file_count": 0, "z": {"omitted_file_count": -1}}, False), ({"omitted_file_count": "5"}, False), ({"omitted_file_count": None}, False), (deep, True), ([[[{"truncated": True}]]], True), ("truncated", False),
        ({"not_truncated": True, "a.truncated": True}, False),
    ]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, (v, _) in enumerate(cases)] + [(90, None), (91, "{")], "i int, t string").withColumn("v", F.try_parse_json("t"))
    got = {r["i"]: r["truncated"] for r in nested.truncated(rows, "v", "i").collect()}
    assert got == {i: hit for i, (_, hit) in enumerate(cases)} | {90: False, 91: False}


def test_paths_and_depths(spark):
    rows = spark.createDataFrame([(1, '{"a": [1, {"b": null}], "c": "x"}'), (2, "[]"), (3, "7")], "i int, t string").withColumn("v", F.try_parse_json("t"))
    got = sorted((r["i"], r["path"], r["name"] or "", r["depth"], r["j"]) for r in nested.entries(rows, "v", "i").select("*", F.to_json("value").alias("j")).collect())
    assert got == [(1, "$.a", "a", 1, '[1,{"b":null}]'), (1, "$.a[0]", "", 2, "1"), (1, "$.a[1]", "", 2, '{"b":null}'), (1, "$.a[1].b", "b", 3, "null"), (1, "$.c", "c", 1, '"x"')]


def test_coverage_of_spans(spark):
    rng = random.Random(3)
    rows = [(k, a, a + rng.randint(0, 12)) for k in "abc" for a in (rng.randrange(120) for _ in range(25))] * 2 + [("d", 5, 5)]
    got = {r["k"]: (r["spans"], r["stretches"], r["covered"]) for r in evidence.coverage(spark.createDataFrame(rows, "k string, start bigint, end bigint"), "k").collect()}
    want = {}
    for k in "abc":
        mine = sorted({(a, b) for x, a, b in rows if x == k and a < b})
        cells, stretches, reach = set(), 0, None
        for a, b in mine:
            cells |= set(range(a, b))
            stretches += reach is None or a > reach
            reach = max(b, reach or b)
        want[k] = (sum(x == k and a < b for x, a, b in rows), stretches, len(cells))
    assert got == want


def test_parts_cover_their_text(spark):
    """Parts of a split text overlap, and together they cover it once."""
    texts = [(i, "".join(f"line {j} {'x' * (j % 37)}\n" for j in range(40 * i))) for i in range(1, 5)]
    df = spark.createDataFrame(texts, "i int, text string")
    parts = df.select("i", F.explode(evidence.split(900)("text")).alias("p")).select("i", "p.*")
    # A part's place: what the cores before it hold, less what it has before its own core.
    at = F.sum("core_chars").over(Window.partitionBy("i").orderBy("part_index")) - F.col("core_chars") - F.col("prefix_chars")
    spans = parts.withColumn("start", at).withColumn("end", F.col("start") + F.length("text"))
    got = {r["i"]: (r["stretches"], r["covered"]) for r in evidence.coverage(spans, "i").collect()}
    assert got == {i: (1, len(t)) for i, t in texts}


def test_statistics(spark):
    hunk = "array<struct<old_start: bigint, old_count: bigint, new_start: bigint, new_count: bigint, lines: string>>"
    h = (1, 1, 1, 1, "x")
    delta = spark.createDataFrame([("s", "a.c", [h, h]), ("s", "b.c", [])], f"submission_id string, path string, hunks {hunk}")
    files = spark.createDataFrame([("s", "a.c", 5, None), ("s", "x/run.sh", 3, "file_budget"), ("s", "Makefile", 1, None), ("t", "b.c", 2, "total_budget")], "submission_id string, path string, bytes_read bigint, omission_reason string")
    got = {r["submission_id"]: tuple(r)[1:] for r in evidence.statistics(delta, files).collect()}
    assert got == {"s": (3, 9, 1, 2, 1, 1, 2, 3), "t": (1, 2, 1, 0, 0, 1, 0, 0)}

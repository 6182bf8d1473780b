"""Rules that labs hold as data: globs in a column, guarded navigation, limits, what is chosen and what is absent."""

import json

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import text as T
from tarnwork.operators import bundles, delta, rules

GLOBS = [
    ("src/**", "src/a/b.c", True), ("student/*", "student/a/b", False), ("student/*", "student/a", True), ("datasets/*.jsonl", "datasets/x.jsonl", True), ("a?c", "a/c", False), ("a?c", "abc", True),
    (".env", "xenv", False), (".env", ".env", True), ("a", "a\n", False), ("**", "x\ny", False), ("*", "x\ny", True), ("***", "a/b", True), ("a+(b)[c]{2}|^$", "a+(b)[c]{2}|^$", True), ("é*", "éü", True),
    ("", "", False), ("/a", "/a", False), ("a/", "a/", False), ("a//b", "a//b", False), ("./a", "./a", False), ("a/..", "a/..", False), ("a\\*", "a\\b", False), ("a\0", "a\0", False), ("#x y", "#x y", True),
]


def test_globs_in_a_column(spark):
    df = spark.createDataFrame([(p, x) for p, x, _ in GLOBS], "p string, x string")
    found = [bool(r[0]) for r in df.select(F.rlike("x", T.any_glob(F.array("p")))).collect()]
    assert found == [hit for *_, hit in GLOBS]
    both = spark.createDataFrame([(["", "a/*"], "a/b"), (["x", "y/**"], "y/1/2"), ([], "a"), (["/bad"], "a")], "p array<string>, x string")
    assert [r[0] for r in both.select(F.rlike("x", T.any_glob(F.col("p")))).collect()] == [True, True, None, None]


def home(**kw):
    return {"spec": {"submissions": {"home": kw}}}


DEFINITIONS = {
    "sound": home(required=["src/*.f90"], allow=["data/**", "x?"], maxFileBytes=300_000) | {},
    "wrong": home(required="src/*", allow=[1, None, ["a"], "ok/*"], maxFileBytes="900000", maxTotalBytes=True),
    "float": home(allow={"0": "a"}, maxFileBytes=5e6, maxTotalBytes=2_000_000.0),
    "large": home(maxFileBytes=10**20, maxTotalBytes=-(10**20)),
    "list": {"spec": {"submissions": [{"home": {"allow": ["a"]}}]}},
    "text": {"spec": "home"},
    "upload": {"spec": {"submissions": {"upload": {"maxFileBytes": 10, "maxTotalBytes": 3_000_000, "allow": ["up"]}, "home": None}}},
}


def labs(spark):
    rows = [(k, json.dumps(v)) for k, v in DEFINITIONS.items()] + [("broken", '{"spec": '), ("none", None), ("array", "[1]"), ("empty", "")]
    return spark.createDataFrame(rows, "lab_id string, lab_definition string")


def test_definitions_are_navigated_with_guards(spark):
    got = {r["lab_id"]: r for r in rules.lab_rules(labs(spark)).collect()}
    plain = (rules.MAX_FILE_BYTES, rules.MAX_TOTAL_BYTES)
    assert {k: (list(r["required"]), list(r["allowed"])) for k, r in got.items() if r["required"] or r["allowed"]} == {"sound": (["src/*.f90"], ["data/**", "x?"]), "wrong": ([], ["ok/*"])}
    limits = {k: (r["file_limit"], r["total_limit"]) for k, r in got.items()}
    assert limits.pop("sound") == (300_000, plain[1]) and limits.pop("large") == ((1 << 63) - 1, plain[1]) and limits.pop("upload") == (plain[0], 3_000_000)
    assert set(limits.values()) == {plain} and len(limits) == 8


def test_each_file_meets_its_own_labs_rules(spark):
    files = [("s", lab, p, 10) for lab in ("sound", "wrong", "none", "unknown") for p in ("src/a.f90", "ok/z", "data/d/e", "xy", "Makefile", "a/run.PY", "notes", "../src/a.f90", "data//x")]
    df = spark.createDataFrame(files, "submission_id string, lab_id string, path string, size bigint")
    got = {}
    for r in rules.source_files(df, rules.lab_rules(labs(spark))).collect():
        got.setdefault(r["lab_id"], set()).add(r["path"])
    known = {"Makefile", "a/run.PY"}
    assert got == {"sound": known | {"src/a.f90", "data/d/e", "xy"}, "wrong": known | {"ok/z"}, "none": known, "unknown": known}


def test_limits_of_each_lab_in_the_budget(spark):
    files = spark.createDataFrame([("s", "a", "1.c", 7), ("s", "a", "2.c", 7), ("t", "b", "1.c", 7), ("t", "b", "2.c", 7)], "submission_id string, lab_id string, path string, size bigint")
    some = spark.createDataFrame([("a", json.dumps(home(maxFileBytes=6, maxTotalBytes=9))), ("b", json.dumps(home(maxFileBytes=2)))], "lab_id string, lab_definition string")
    policy = rules.Policy(file_bytes=4, total_bytes=5)
    met = rules.source_files(files, rules.lab_rules(some, policy=policy), policy)
    read = bundles.read_budget(met, F.col("file_limit"), F.col("total_limit")).orderBy("submission_id", "path").collect()
    assert [(r["bytes_read"], r["omission_reason"]) for r in read] == [(6, "file_budget"), (3, "total_budget"), (4, "file_budget"), (1, "total_budget")]


@pytest.mark.parametrize("declared, gone", [(["src/a.f90"], {"data/x", "data/y/z"}), (["data/x", "data/y/z", "src/a.f90", "own"], set())])
def test_baseline_files_that_are_absent(spark, declared, gone):
    base = spark.createDataFrame([(lab, p, "one\n", "r", "baseline") for lab in ("sound", "none") for p in ("src/a.f90", "data/x", "data/y/z", "doc")], "lab_id string, path string, content string, revision string, kind string")
    files = spark.createDataFrame([(s, lab, p, "one\n", None) for s, lab in (("s", "sound"), ("t", "none")) for p in declared], "submission_id string, lab_id string, path string, content string, omission_reason string")
    found = delta.build(files.filter("path <> 'own'"), base, rules.lab_rules(labs(spark)))
    assert {(r["submission_id"], r["path"], r["removed_text"]) for r in found.collect()} == {("s", p, "one\n") for p in gone}

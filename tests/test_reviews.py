"""Scope, evidence, verdicts, reports, runs, sinks on small hand-made inputs."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwork import catalogue, sinks
from tarnwork.operators import evidence, reports, rules, runs, scope, verdicts, workspace
from tarnwork.sources import files as sources
from tarnwork.sources import settings

BUNDLE = "submission_id string, path string, content string, truncated boolean"


def bundle(spark, **files):
    return spark.createDataFrame([("s", p.replace("__", "/").replace("_dot_", "."), t, False) for p, t in files.items()], BUNDLE)


def test_scope_follows_builds_and_includes(spark):
    f = bundle(spark, CMakeLists_dot_txt="add_executable(x src/a.cpp b.f90)", run_dot_sh="./x", compile_dot_sh="cmake .", src__a_dot_cpp='#include "a.h"\n', src__a_dot_h='#include "loop.h"', src__loop_dot_h='#include "a.h"', src__b_dot_f90="x", src__unused_dot_cpp="y", data_dot_bin="z", AMSS_NCKU_Input_dot_py="MPI_processes=1")
    got = {r["path"]: r["reasons"] for r in scope.scope_reasons(f).collect()}
    assert set(got) == {"CMakeLists.txt", "run.sh", "compile.sh", "src/a.cpp", "src/a.h", "src/loop.h", "src/b.f90"}
    assert got["CMakeLists.txt"] == ["build_definition", "mandatory_execution_file"]
    assert got["src/a.h"] == ["included_by:src/a.cpp", "included_by:src/loop.h"]
    out = {r["path"]: r["reason"] for r in scope.excluded(f, scope.scope_reasons(f)).collect()}
    assert out == {"src/unused.cpp": "outside_static_build_include_runtime_closure", "data.bin": "outside_static_build_include_runtime_closure", "AMSS_NCKU_Input.py": "judge_reads_only_mpi_omp_literals"}


def test_scope_fallbacks(spark):
    f = bundle(spark, compile_dot_sh="meson build", src__a_dot_c="", src__b_dot_c="")
    got = {r["path"]: r["reasons"] for r in scope.scope_reasons(f).collect()}
    assert got["src/a.c"] == ["conservative_dynamic_build_fallback"]
    g = bundle(spark, compile_dot_sh="gcc src/[ab]*.c", src__zz_dot_c="")
    assert {r["path"]: r["reasons"] for r in scope.scope_reasons(g).collect()}["src/zz.c"] == ["conservative_no_static_source_match"]
    h = bundle(spark, compile_dot_sh="gcc src/a*.c", src__ab_dot_c="", run_dot_sh="cd src\n./a table.dat", src__table_dot_dat="1", src__other_dot_dat="2")
    got = {r["path"]: r["reasons"] for r in scope.scope_reasons(h).collect()}
    assert got["src/ab.c"] == ["matched_build_glob:src/a*.c"] and got["src/table.dat"] == ["runtime_asset_with_src_working_directory"] and "src/other.dat" not in got


def test_reference_and_macros(spark):
    files = spark.createDataFrame([("s", f"src/{i}.c", "x\r\n" if i < 9 else "mine", 20_000) for i in range(12)], "submission_id string, path string, content string, declared_bytes bigint")
    refs = spark.createDataFrame([(r, f"src/{i}.c", "x\n") for r in ("r1", "r2") for i in range(12)], "revision string, path string, content string")
    m = scope.reference_match(files, refs).withColumn("ord", F.when(F.col("revision") == "r1", 1).otherwise(2))
    row = m.first()
    assert (row["exact_file_count"], row["exact_bytes"], row["comparable_file_count"], row["exact_ratio"]) == (9, 180_000, 12, 0.75)
    assert scope.best_reference(m, m.limit(0)).first()["revision"] == "r2"  # of equal ones, the last configured
    same = m.filter("revision = 'r1'").select("submission_id", "exact_bytes", "exact_file_count")
    assert scope.best_reference(m, same).collect() == []  # the course matches as well
    code = spark.createDataFrame([("s", "src/macrodef.fh", "#define GAUGE 1\n#define Cell\n"), ("s", "src/macrodef.h", "#define GAUGE 2\n#define other 3\n")], "submission_id string, path string, content string")
    course = spark.createDataFrame([("src/macrodef.h", "#define GAUGE 2\n#define RPS 1\n")], "path string, content string")
    got = {r["name"]: (r["submission"], r["course"], r["matches_course"]) for r in scope.compare_macros(scope.macros(code, "submission_id"), scope.macros(course)).collect()}
    assert got == {"GAUGE": ("2", "2", True), "Cell": (None, None, True), "RPS": (None, "1", False)}


def test_input_parameters(spark):
    df = spark.createDataFrame([("MPI_processes = 4\nOMP_threads = 2\nMPI_processes = 8\n",), ("OMP_threads = True",), ("MPI_processes = f()",), ("MPI_processes = 40\nOMP_threads = 2",), ("",), ("x ==",)], "t string")
    got = [r[0] for r in df.select(scope.input_parameters(60, 30)("t")).collect()]
    assert (got[0]["mpi"], got[0]["omp"], got[0]["valid_product"]) == (8, 2, True)
    assert got[4]["mpi"] == 30 and got[3]["valid_product"] is False
    assert all(got[i]["error"] for i in (1, 2, 3, 5))


def test_split_parts_rebuild_the_text():
    rng = random.Random(2)
    for most in (10, 64, 1000):
        text = "".join(rng.choice("abcdef\n") * rng.randint(1, 6) for _ in range(500))
        parts = evidence.split_text(text, most)
        assert "".join(p["text"][p["core_start"] : p["core_start"] + p["core_chars"]] for p in parts) == text
        assert all(len(p["text"]) <= most + 1 for p in parts) and parts[0]["part_count"] == len(parts)
        if most == 1000:
            assert all(p["text"][p["core_start"] + p["core_chars"] - 1] == "\n" for p in parts[:-1])
    assert [p["text"] for p in evidence.split_text("ab", 5)] == ["ab"] and evidence.split_text("", 5)[0]["core_chars"] == 0


def plain_budgets(items, most):
    weights = {k: max(s, 1) * max(p, 1) for k, s, p in items}
    out = {k: min(s, max(1, max(1, most) * weights[k] // sum(weights.values()))) for k, s, _ in items}
    left = max(1, most) - sum(out.values())
    while left > 0:
        grown = False
        for k, s, _ in sorted(items, key=lambda x: (-x[2], -x[1], x[0])):
            if out[k] < s and left:
                out[k] += 1
                left -= 1
                grown = True
        if not grown:
            return out
    return out


def test_budgets_go_round():
    rng = random.Random(7)
    for _ in range(60):
        items = [(f"f{i}", rng.randint(0, 300), rng.choice([1, 2, 4])) for i in range(rng.randint(1, 9))]
        most = rng.randint(1, 900)
        got = evidence.allocate([s for _, s, _ in items], [p for *_, p in items], [k for k, *_ in items], most)
        assert dict(zip((k for k, *_ in items), got)) == plain_budgets(items, most)


def test_chunks(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.randint(1, 60)) for k in "ab" for i in range(40)]
    got = {(r["k"], r["i"]): r["chunk"] for r in evidence.pack(spark.createDataFrame(rows, "k string, i int, size int"), "k", ["i"], "size", 100, 10).collect()}
    for k in "ab":
        used, chunk, some = 10, 0, False
        for _, i, s in [r for r in rows if r[0] == k]:
            if some and used + s > 100:
                used, chunk = 10, chunk + 1
            used, some = used + s, True
            assert got[k, i] == chunk


def test_verdicts(spark):
    good = '{"decision": "compliant", "confidence": 1}'
    df = spark.createDataFrame([("noise {x} " + good + " {}", None), ("none", good), (None, None)], "content string, reasoning string")
    got = [r[0] for r in df.select(verdicts.first_verdict(F.col("content"), F.col("reasoning"), lambda v: "decision" in v)).collect()]
    assert got[0] == got[1] == '{"confidence": 1, "decision": "compliant"}' and got[2] is None
    v = spark.createDataFrame([("t", 0, "compliant", 0.9, ["b", "a"], 2), ("t", 1, "violation", 0.4, ["a", "c"], 2), ("u", 0, "compliant", None, [], 2)], "task string, chunk_index int, decision string, confidence double, violations array<string>, chunk_count int")
    got = {r["task"]: (r["decision"], r["confidence"], r["violations"]) for r in verdicts.merge(v, "task").collect()}
    assert got == {"t": ("violation", 0.4, ["b", "a", "c"]), "u": ("inconclusive", 0.0, [])}


def test_pair_sides_and_latest(spark):
    e = "array<struct<first_path: string, second_path: string, description: string>>"
    p = spark.createDataFrame([("k", "a", "b", [("x", "y", "d")])], f"key string, first_id string, second_id string, evidence {e}")
    got = {r["submission_id"]: (r["counterpart_id"], r["evidence"][0]["submission_path"]) for r in reports.both_sides(p).collect()}
    assert got == {"a": ("b", "x"), "b": ("a", "y")}


def test_runs(spark):
    ev = spark.createDataFrame([("r", 1, "queued", 1, None), ("r", 2, "preparing", 2, None), ("r", 3, "failed", 3, "JOB_LOST"), ("q", 1, "preparing", 1, None), ("q", 2, "finalizing", 5, None)], "run_id string, sequence int, state string, updated_at int, error_code string")
    now = runs.current(ev).withColumn("source", F.lit("nightly"))
    assert {r["run_id"]: (r["state"], r["attempts"]) for r in now.collect()} == {"r": ("failed", 1), "q": ("finalizing", 1)}
    assert [r["run_id"] for r in runs.reconcile(now, 5, True).collect()] == ["r"] and runs.reconcile(now, 5, True, most=1).collect() == []
    done = now.filter("run_id = 'q'").select("run_id")
    assert {r["run_id"]: r["state"] for r in runs.recover(now, done).collect()} == {"r": "failed", "q": "completed"}
    assert {r["run_id"]: r["error_code"] for r in runs.recover(now, done.limit(0)).collect()} == {"r": "JOB_LOST", "q": "JOB_LOST"}


def test_line_counts_of_carriage_returns(spark):
    f = spark.createDataFrame([("submission", "a", "1\r2\r3"), ("submission", "b", "1\n2"), ("submission", "c", "")], "root string, path string, content string")
    assert workspace.numbered(f, "path").groupBy("path").count().collect() and {r["path"]: r["lines"] for r in workspace.file_info(f, "path").collect()} == {"a": 1, "b": 2, "c": 0}
    assert workspace.numbered(f, "path").filter("path = 'a'").count() == 3


def test_create_only(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "k string, v int")
    path = str(tmp_path / "t")
    sinks.create_only(rows(("a", 1), ("a", 1)), path, "k")
    sinks.create_only(rows(("a", 1), ("b", 2)), path, "k")
    assert sorted(map(tuple, sinks.stored(spark, path).collect())) == [("a", 1), ("b", 2)]
    with pytest.raises(sinks.Conflict):
        sinks.create_only(rows(("a", 9)), path, "k")
    m = lambda v, at: spark.createDataFrame([("r", v, at)], "run_id string, v int, generated_at int")
    sinks.write_manifest(m(1, 10), str(tmp_path / "m"))
    assert sinks.write_manifest(m(1, 20), str(tmp_path / "m")).first()["generated_at"] == 10
    with pytest.raises(sinks.Conflict):
        sinks.write_manifest(m(2, 20), str(tmp_path / "m"))
    ev = lambda *x: spark.createDataFrame(x, "run_id string, state string, updated_at int")
    sinks.append_events(ev(("r", "queued", 1)), str(tmp_path / "e"), runs.STATES)
    sinks.append_events(ev(("r", "preparing", 2), ("s", "queued", 1)), str(tmp_path / "e"), runs.STATES)
    assert sorted((r["run_id"], r["sequence"]) for r in sinks.stored(spark, str(tmp_path / "e")).collect()) == [("r", 1), ("r", 2), ("s", 1)]
    with pytest.raises(ValueError):
        sinks.append_events(ev(("r", "odd", 3)), str(tmp_path / "e"), runs.STATES)


def test_sources(spark, tmp_path):
    for root, text in (("one", "first"), ("two", "second")):
        d = tmp_path / root / "s" / "src"
        d.mkdir(parents=True)
        (d / "a.c").write_bytes(text.encode() + b"\xff")
    (tmp_path / "two" / "s" / "src" / "b.c").write_text("only")
    manifest = spark.createDataFrame([("s", "l", "src/a.c", 6), ("s", "l", "src/b.c", 4), ("s", "l", "notes", 1), ("s", "l", "../x.c", 1)], "submission_id string, lab_id string, path string, size bigint")
    labs = spark.createDataFrame([("l", '{"spec": {"submissions": {"upload": {"maxTotalBytes": 8}}}}')], "lab_id string, lab_definition string")
    got = {r["path"]: (r["content"], r["omission_reason"]) for r in sources.bundles_from_roots(spark, [str(tmp_path / "one"), str(tmp_path / "two")], manifest, labs, rules.Policy(total_bytes=1)).collect()}
    assert got == {"src/a.c": ("first�", None), "src/b.c": ("on", "total_budget")}
    own = tmp_path / "owners" / "alice"
    own.mkdir(parents=True)
    (own / "1.json").write_text('{"id": "x", "n": 1}')
    (own / "2.json").write_text("{broken")
    assert [(r["id"], r["owner"]) for r in sources.reports(spark, str(tmp_path / "owners/*/*.json"), "id string, n int").collect()] == [("x", "alice")]
    for name, ready in (("r1", True), ("r2", False)):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "metadata.json").write_text('{"run_id": "%s"}' % name)
        if ready:
            (tmp_path / "runs" / name / "_READY").write_text("")
    assert [r["run_id"] for r in sources.ready_runs(spark, str(tmp_path / "runs"), "run_id string").collect()] == ["r1"]


def test_signed_and_closed(spark):
    e = spark.createDataFrame([("eyJhIjoxfQ", "k", "AA"), ("eyJhIjoxfQ==", "k", "AA"), ("eyJiIjoxfQ", "k", "_w")], "payload string, key_id string, signature string")
    got = sources.signed_payloads(e, lambda payload, key, sig: sig == b"\0").collect()
    assert [r["text"] for r in got] == ['{"a":1}']
    df = spark.createDataFrame([('{"a":1}',), ('{"a":1,"b":2}',), ("{}",)], "t string")
    assert [r[0] is not None for r in df.select(sources.closed(F.col("t"), "a int", ["a"])).collect()] == [True, False, False]
    assert settings.load().threshold == 0.7


def test_null_and_carriage_return_texts_have_rows(spark, tmp_path):
    texts = [None, "", "a\r\nbb\r\n", "a\rb", "a\nb\n", "a\r\n\r\nb"]
    spark.createDataFrame([(i, x, "en", "s") for i, x in enumerate(texts)], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    hunks = {r["doc_id"]: (r["new_count"], r["bytes"]) for r in catalogue.fallback_hunks(spark, str(tmp_path)).collect()}
    assert hunks == {0: (0, 0), 1: (0, 0), 2: (2, 5), 3: (2, 3), 4: (2, 4), 5: (3, 4)}
    info = {r["doc_id"]: (r["bytes"], r["lines"]) for r in catalogue.file_info(spark, str(tmp_path)).collect()}
    assert sorted(info) == list(range(6)) and info[0] == info[1] == (0, 0) and info[4] == (4, 2)

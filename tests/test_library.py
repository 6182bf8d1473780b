"""Scope globs, payloads, envelopes, ledger, sinks, streams: cases by hand, and plain versions of what SQL does not say."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tarnwork import catalogue, sinks
from tarnwork.functions import hashing
from tarnwork.functions import text as T
from tarnwork.operators import evidence, identity, payloads, reports, runs, scope, similarity, workspace
from tarnwork.sources import catalogue as source
from tarnwork.sources import envelopes, files, settings
from tarnwork.streaming import run_states

AT = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "glob, path, hit",
    [("src/a[", "src/a[", True), ("src/a[", "src/ab", False), ("src/[ab].c", "src/b.c", True), ("src/[ab].c", "src/c.c", False), ("src/[z-a]*.c", "src/z.c", False), ("src/[]]x.c", "src/]x.c", True), ("src/[a-c]?.c", "src/bx.c", True)],
)
def test_build_globs_never_crash(spark, glob, path, hit):
    f = spark.createDataFrame([("s", "compile.sh", f"gcc {glob} x", False), ("s", path, "", False), ("s", "src/keep.c", "", False), ("s", "CMakeLists.txt", "add(src/keep.c)", False)], "submission_id string, path string, content string, truncated boolean")
    got = {r["path"]: r["reasons"] for r in scope.scope_reasons(f).collect()}
    assert (f"matched_build_glob:{glob}" in got.get(path, [])) is hit


def test_names_with_regex_signs(spark):
    f = spark.createDataFrame([("s", "compile.sh", r"gcc a\Eb+.o", False), ("s", r"src/a\Eb+.c", "", False), ("s", "src/axb.c", "", False)], "submission_id string, path string, content string, truncated boolean")
    got = {r["path"]: r["reasons"] for r in scope.scope_reasons(f).collect()}
    assert got[r"src/a\Eb+.c"] == ["referenced_by_build_definition"] and "src/axb.c" not in got


def plain_cut(text, most):
    return text[: max(1, most)]


def test_payloads_share_a_budget(spark):
    hunk = lambda n, c: (1, 1, 1, 1, c * n)
    kind = "submission_id string, path string, baseline_kind string, baseline_revision string, added_text string, removed_text string, hunks array<struct<old_start: bigint, old_count: bigint, new_start: bigint, new_count: bigint, lines: string>>"
    deltas = spark.createDataFrame([("s", "b.c", "course", "r", "xx", "", [hunk(900, "x"), hunk(300, "y")]), ("s", "run.sh", "course", "r", "z", "", [hunk(50, "z")])], kind)
    bundle = spark.createDataFrame([("s", "run.sh", "q" * 700, 700, 700, None), ("s", "b.c", "w" * 50, 50, 50, None)], "submission_id string, path string, content string, size bigint, bytes_read bigint, omission_reason string")
    subs = spark.createDataFrame([("s", "o", "l", 60, "d" * 500, "{}", "g", False)], "submission_id string, owner string, lab_id string, score int, document string, definition string, delta_digest string, incomplete boolean")
    total = 900
    row = payloads.compliance(subs, deltas, bundle, total).first()
    got = json.loads(row["payload"])
    doc = min(500, total // 3)
    rest = total - doc - 2
    shares = dict(zip(("b.c", "run.sh"), evidence.allocate([1200, 50], [2, 4], ["b.c", "run.sh"], rest * 2 // 3)))
    hunks = evidence.allocate([900, 300], [1, 1], ["0", "1"], shares["b.c"])
    files_ = {f["path"]: f for f in got["baseline_delta"]["files"]}
    assert [h["text"]["text"] for h in files_["b.c"]["hunks"]] == [plain_cut("x" * 900, hunks[0]), plain_cut("y" * 300, hunks[1])]
    assert files_["run.sh"]["hunks"][0]["text"]["text"] == "z" * shares["run.sh"] and row["incomplete"] is True
    assert got["source_context"]["files"][0]["content"]["text"] == "q" * (rest - rest * 2 // 3) and got["source_context"]["omitted_unchanged_file_count"] == 1
    assert got["review_basis"]["experiment_document"]["text"] == "d" * doc and list(got) == sorted(got)
    assert payloads.compliance(subs, deltas, bundle, 9000).first()["incomplete"] is False


def test_chunks_hold_their_items_json(spark):
    items = spark.createDataFrame([("t", i, "p" * 40, "a\n" * n) for i, n in enumerate([100, 9000, 30, 20000, 5])], "task string, item_index int, path string, text string")
    got = payloads.chunks(items, "task", ["item_index"], 40_000, 100)
    used = {r["chunk"]: r["n"] for r in got.groupBy("chunk").agg(F.sum("prompt_chars").alias("n")).collect()}
    assert sorted(used) == list(range(len(used))) and len(used) > 1 and all(n + 100 <= 40_000 for n in used.values())
    core = got.orderBy("item_index", "part_index").select("item_index", F.expr("substring(text, core_start + 1, core_chars)").alias("c")).collect()
    assert ["".join(r["c"] for r in core if r["item_index"] == i) for i in range(5)] == ["a\n" * n for n in (100, 9000, 30, 20000, 5)]


def test_definitions_that_hunks_name(spark):
    hunks = spark.createDataFrame([("s", "a.c", 0, "+x = LIMIT + other;"), ("s", "d.h", 0, "+LIMIT")], "submission_id string, path string, item_index int, text string")
    rest = spark.createDataFrame([("s", "d.h", "#define LIMIT 3\n#define UNUSED 4\n")], "submission_id string, path string, content string")
    assert [(r["path"], r["defined_in"], r["symbol"], r["value"]) for r in evidence.referenced_definitions(hunks, rest).collect()] == [("a.c", "d.h", "LIMIT", "3")]


SHA, ONE, TWO = "a" * 64, "00000000-0000-4000-8000-000000000001", "00000000-0000-4000-8000-000000000002"


def pair_payload(**change):
    member = lambda i: {"id": i, "owner": "o", "lab_id": "l", "score": 3, "input_digest": SHA, "submitted_at": "2024-01-01T00:00:00Z", "input_manifest": {"files": [{"path": "a", "size": 1, "sha256": SHA}]}}
    out = {
        "schema_version": 1, "audience": "checker", "target_submission_id": ONE, "submissions": [member(ONE), member(TWO)], "lab_definition": {"k": 1}, "model": "m", "source": "manual", "rules_version": "r",
        "basis": {"commit": "c", "tree_digest": SHA, "document_digest": SHA, "source_path": "s", "document_path": "d", "public_references": []}, "prompt_version": "plagiarism-v2",
        "result_schema_version": "plagiarism-result-v1", "issued_at": "2024-01-01T00:00:00Z", "expires_at": "2024-01-01T00:10:00Z", "nonce": "n" * 16,
    }
    return json.dumps(out | change)


def test_pair_payloads(spark):
    good = json.loads(pair_payload())["submissions"]
    cases = [
        (pair_payload(), None), ("{", "not JSON"), (pair_payload(extra=1), "payload has other fields"), (pair_payload(submissions=[]), "the corpus is not of 1 to 1000 submissions"),
        (pair_payload(submissions=[good[0], good[0]]), "a submission comes twice"), (pair_payload(submissions=[good[0], good[1] | {"lab_id": "m"}]), "submissions are of several labs"),
        (pair_payload(submissions=[good[1]]), "the target is not in the corpus"), (pair_payload(submissions=[good[0] | {"score": True}]), "payload.submissions[].score is not count"),
        (pair_payload(schema_version=2), "payload.schema_version is not one of 1"), (pair_payload(schema_version="1"), "payload.schema_version is not one of 1"), (pair_payload(audience="other"), "payload.audience is not one of checker"),
        (pair_payload(nonce="short"), "payload.nonce is not nonce"), (pair_payload(expires_at="2024-01-01T01:00:00Z"), "it is valid for more than 15 minutes"),
    ]
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, text string")
    got = {r["i"]: r["error"] for r in envelopes.pair_errors(rows, F.lit("2024-01-01 00:05:00").cast("timestamp"), 1, "checker").collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)}
    corpus = envelopes.corpus(rows, F.lit("2024-01-01 00:05:00").cast("timestamp"), 1, "checker").collect()
    assert [(r["target_id"], r["id"], r["input_manifest"]["files"][0]["path"]) for r in corpus] == [(ONE, ONE, "a"), (ONE, TWO, "a")]


def test_bases_and_caps(spark):
    b = lambda c: spark.createDataFrame([("l", c, "t")], "lab_id string, basis_commit string, basis_tree_digest string")
    identity.require_bases(b("c"), b("c"))
    with pytest.raises(ValueError, match="basis_commit"):
        identity.require_bases(b("c"), b("d"))
    some = spark.range(5)
    assert similarity.within_cap(some, 5).count() == 5
    with pytest.raises(ValueError):
        similarity.within_cap(some, 4)
    t = spark.createDataFrame([("plagiarism", "l", "b"), ("compliance", "m", "a"), ("compliance", "l", "z")], "kind string, lab_id string, task_key string")
    assert [tuple(r) for r in reports.in_order(t).collect()] == [("compliance", "l", "z"), ("compliance", "m", "a"), ("plagiarism", "l", "b")]
    c = spark.createDataFrame([("m", "a", "b"), ("l", "c", "d"), ("l", "a", "z")], "lab_id string, first_id string, second_id string")
    assert [tuple(r) for r in similarity.in_order(c).collect()] == [("l", "a", "z"), ("l", "c", "d"), ("m", "a", "b")]


def test_pages_shrink(spark):
    rows = spark.createDataFrame([(i, "x" * 100) for i in range(20)], "i int, t string")
    got = workspace.fitting_page(rows, ["i"], 5, 10, 400).collect()
    assert [r["i"] for r in got] == [5, 6, 7] and {r["next_cursor"] for r in got} == {8}
    assert {r["next_cursor"] for r in workspace.fitting_page(rows, ["i"], 15, 10, 4000).collect()} == {None}
    f = spark.createDataFrame([("r", "a", "one\ntwo")], "root string, path string, content string")
    assert workspace.call("search", f, "two", "path").count() == 1
    with pytest.raises(ValueError):
        workspace.call("delete", f)


def test_indexes_and_copies(spark, tmp_path):
    r = spark.createDataFrame([("o", "s1", "l", "violation", "k1", 1), ("o", "s2", "l", "compliant", "k2", 2), ("p", "s3", "l", "compliant", "k3", 1)], "owner string, submission_id string, lab_id string, decision string, review_key string, completed_at int")
    got = {x["owner"]: x for x in sinks.owner_index(r, str(tmp_path / "o")).collect()}
    assert got["o"]["reports"] == 2 and got["o"]["violations"] == 1 and [v["submission_id"] for v in got["o"]["reviews"]] == ["s2", "s1"]
    p = spark.createDataFrame([("l", "b", "a", "plagiarism", "exact", 1.0, "k", 1), ("m", "c", "d", "independent", "minor_edit", 0.7, "j", 2)], "lab_id string, first_id string, second_id string, decision string, relationship string, jaccard double, review_key string, completed_at int")
    assert sorted((x["lab_id"], x["low_id"], x["high_id"]) for x in sinks.pair_index(p, str(tmp_path / "p")).collect()) == [("l", "a", "b"), ("m", "c", "d")]
    f = spark.createDataFrame([("x", "one"), ("y", "two"), ("z", "not declared")], "path string, content string")
    declared = f.filter("path <> 'z'").select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
    assert sorted(x["path"] for x in sinks.materialise(declared, f, str(tmp_path / "w"), "path").collect()) == ["x", "y"]
    with pytest.raises(sinks.Conflict):
        sinks.materialise(declared.withColumn("size", F.lit(9)), f, str(tmp_path / "v"), "path")
    assert not (tmp_path / "v").exists()


def test_results_and_summaries(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "compliant", None), ("k2", None, "lost")], "task_key string, decision string, error string")
    sinks.write_results(rows, str(tmp_path))
    assert sinks.stored(spark, f"{tmp_path}/results").count() == 1 and sinks.stored(spark, f"{tmp_path}/attempts").count() == 2
    summary = lambda n: spark.createDataFrame([(3, n)], "tasks int, failed int")
    assert sinks.write_summary(summary(1), str(tmp_path)).endswith("attempt_summaries") and sinks.write_summary(summary(0), str(tmp_path)).endswith("/summary")
    with pytest.raises(sinks.Conflict):
        sinks.write_summary(spark.createDataFrame([(4, 0)], "tasks int, failed int"), str(tmp_path))
    reviews = spark.createDataFrame([("a", "violation"), ("b", "inconclusive")], "review_key string, decision string")
    sinks.record_reviews(reviews, f"{tmp_path}/ledger")
    assert [r["review_key"] for r in sinks.stored(spark, f"{tmp_path}/ledger").collect()] == ["a"]


def test_stored_pairs(spark):
    kind = "task_key string, review_key string, confidence double, jaccard double, human_review_status string, conclusive boolean, decision string, first_id string, second_id string"
    rows = spark.createDataFrame([(SHA, SHA, 0.5, 0.9, "pending", True, "plagiarism", "a", "b"), (SHA, SHA, 1.5, 0.9, "pending", True, "plagiarism", "a", "b"), (SHA, SHA, 0.5, 0.9, "pending", True, "inconclusive", "a", "b"), (SHA, SHA, 0.5, 0.9, "pending", True, "plagiarism", "a", "a")], kind)
    assert reports.valid_pairs(rows).count() == 1


def test_catalogue_rows(spark, monkeypatch):
    row = ("s", "o", "l", 60, SHA, {"files": [{"path": "a.c", "size": 1, "sha256": SHA}, {"path": "b.c", "size": 2, "sha256": SHA}]}, "{}", AT, "Success", True, None, None)
    got = source.manifest_files(source.from_rows(spark, [row])).collect()
    assert [(r["submission_id"], r["path"], r["size"]) for r in got] == [("s", "a.c", 1), ("s", "b.c", 2)]
    monkeypatch.setenv("AUDIT_THRESHOLD", "0.8")
    spark.conf.set("spark.audit.band_size", "8")
    try:
        assert (settings.load(spark).threshold, settings.load(spark).band_size) == (0.8, 8)
    finally:
        spark.conf.unset("spark.audit.band_size")
    c = spark.createDataFrame([('{"b":1,"a":"é"}',), ('{"a":"é", "b": 1}',), (None,)], "j string")
    digests = [r[0] for r in c.select(hashing.canonical_sha256(F.col("j"))).collect()]
    assert digests[0] == digests[1] and digests[2] is None


def test_text_predicates(spark):
    df = spark.createDataFrame([("证据", ONE, "a-b_1.c"), ("plain", "x", "../a"), ("  ", None, "")], "t string, u string, c string")
    got = [tuple(r) for r in df.select(T.has_cjk(F.col("t")), T.is_uuid(F.col("u")), T.is_safe_component(F.col("c"))).collect()]
    assert got == [(True, True, True), (False, False, False), (False, False, False)]
    t = spark.createDataFrame([("l", "b", "2"), ("l", "a", "1")], "lab_id string, path string, content string")
    import hashlib

    want = hashlib.sha256(b"".join(p + b"\0" + hashlib.sha256(c).digest() for p, c in ((b"a", b"1"), (b"b", b"2")))).hexdigest()
    assert files.tree_digest(t, "lab_id").first()["digest"] == want


def test_runs_ready_and_created_once(spark, tmp_path):
    name = "review-" + SHA
    r = spark.createDataFrame([(name,), ("odd",), ("review-" + "b" * 64,)], "run_id string")
    assert [x["run_id"] for x in runs.ready_only(r, r.limit(2)).collect()] == [name]
    rows = spark.createDataFrame([("p", AT), ("p", AT + dt.timedelta(minutes=1)), ("q", AT)], "payload string, created_at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = run_states.created_once(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(x["payload"] for x in spark.read.parquet(str(tmp_path / "out")).collect()) == ["p", "q"]


def test_stream_transitions_equal_batch(spark):
    data = "/root/testdata/sf0.001"
    batch = {r["run_id"]: r["attempts"] for r in catalogue.queries()["attempt_counts"](spark, data).collect()}
    stream = {int(r["run_id"]): r["attempts"] for r in catalogue.queries()["run_state_stream"](spark, data).collect()}
    assert batch == stream


def test_long_texts_shingle_in_linear_time(spark):
    d = spark.createDataFrame([("s", "a.c", " ".join(f"w{i % 30_000}" for i in range(60_000)))], "submission_id string, path string, added_text string")
    assert similarity.shingle_sets(d).select(F.size("shingles")).first()[0] == 30_002


def test_hot_band_and_hot_set(spark):
    """Many copies of one set and of a near one: sets meet once, not their members."""
    base = [f"x{i}" for i in range(40)]
    rows = [(f"a{i:03}", f"o{i % 2}", "l", AT, f"d{i}", f"e{i}", base if i % 3 else base[:-1] + ["y"], False, True) for i in range(120)]
    e = spark.createDataFrame(rows, "id string, owner string, lab_id string, submitted_at timestamp, input_digest string, delta_digest string, shingles array<string>, incomplete boolean, changed_files boolean")
    want = sum(1 for i in range(120) for j in range(i) if i % 2 != j % 2)
    assert similarity.exhaustive_pairs(e).count() == want and similarity.banded_pairs(e).count() == want
    got = similarity.classes(e).collect()
    assert {(r["members"], r["links"]) for r in got} == {(40, 1), (80, 1)} and len(got) == 120


def test_hashes_do_not_go_with_pairs(spark, monkeypatch):
    """Two families whose sets are all alike: hashes are shuffled once for each pair of chunks, not for each pair of sets."""
    base = [[f"{f}{i}" for i in range(60)] for f in "xy"]
    rows = [(f"{f}{i:03}", f"o{i % 2}", "l", AT, f"d{f}{i}", f"e{f}{i}", base[f] + [f"{f}-{i}"], False, True) for f in (0, 1) for i in range(50)]
    e = spark.createDataFrame(rows, "id string, owner string, lab_id string, submitted_at timestamp, input_digest string, delta_digest string, shingles array<string>, incomplete boolean, changed_files boolean")
    for chunk in (4, 32, 1000):
        monkeypatch.setattr(similarity, "CHUNK", chunk)
        got = similarity.exhaustive_pairs(e).collect()
        assert len(got) == 2 * 25 * 25 and {r["jaccard"] for r in got} == {60 / 62}
    tiles, real = [], similarity.staged
    monkeypatch.setattr(similarity, "staged", lambda df, label: tiles.append((label, out := real(df, label))) or out)
    monkeypatch.setattr(similarity, "CHUNK", 32)
    similarity.exhaustive_pairs(e).count()
    held = dict(tiles)["set-tiles"]
    assert held.count() == 2 * 50 * 49 // 2
    # In pairs there would be 4,900 sets of hashes; here at most two for each set and pair of chunks.
    assert held.select("_x", "_y", F.explode(F.array("a", "b"))).distinct().count() <= 100 * 16

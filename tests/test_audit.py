"""Selection, deltas, similarity, bundles: cases of the audit on small hand-made inputs."""

import datetime as dt
import difflib
import random

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import hashing
from tarnwork.functions import text as T
from tarnwork.operators import bundles, delta, identity, selection, similarity
from tarnwork.plans import audit
from tarnwork.sources import catalogue as source
from tarnwork.sources import settings

AT = dt.datetime(2024, 1, 1)


def subs(spark, rows):
    """(id, owner, lab, score, day, digest)"""
    schema = "id string, owner string, lab_id string, score bigint, submitted_at timestamp, input_digest string, status string, is_valid boolean"
    return spark.createDataFrame([(i, o, lab, s, AT + dt.timedelta(days=d), g, "Success", True) for i, o, lab, s, d, g in rows], schema)


def test_best_and_history(spark):
    df = subs(spark, [("a1", "a", "l", 70, 1, "x"), ("a2", "a", "l", 70, 2, "y"), ("b1", "b", "l", 90, 1, "z"), ("b2", "b", "l", 59, 3, "z"), ("c1", "c", "l", 99, 9, "x"), ("c2", "c", "m", 60, 1, "x")])
    history = selection.eligible(df, 60, F.lit(AT + dt.timedelta(days=5)))
    assert [r["id"] for r in selection.snapshot(history).collect()] == ["a1", "a2", "b1", "c2"]
    assert {r["id"] for r in selection.best(history).collect()} == {"a2", "b1", "c2"}  # a tie goes to the later one
    assert [r["id"] for r in selection.snapshot(history, 2).collect()] == ["a1", "a2"]
    with pytest.raises(ValueError):
        selection.snapshot(history, 0)


def entities(spark, rows):
    """(id, owner, day, digest, shingles, incomplete)"""
    schema = "id string, owner string, lab_id string, submitted_at timestamp, input_digest string, delta_digest string, shingles array<string>, incomplete boolean, changed_files boolean"
    return spark.createDataFrame([(i, o, "l", AT + dt.timedelta(days=d), g, g + "d", s, inc, True) for i, o, d, g, s, inc in rows], schema)


def test_repeats_of_one_owner_surface_in_the_near_layer(spark):
    e = entities(spark, [("a1", "A", 1, "x", ["p", "q"], False), ("a2", "A", 2, "x", ["p", "q"], False), ("b1", "B", 3, "x", ["p", "q"], False)])
    want = [("a1", "b1", "exact_submission", 1.0), ("a2", "b1", "minhash", 1.0)]
    for mode in ("exhaustive", "lsh"):
        assert sorted(tuple(r)[1:] for r in similarity.detect(e, mode=mode).collect()) == want
    target = e.filter("id = 'b1'")
    assert sorted(tuple(r)[1:3] + (r["signal"],) for r in similarity.target_against(e, target).collect()) == [("a1", "b1", "exact_submission"), ("a2", "b1", "exact_submission")]


def test_incomplete_only_match_whole_submissions(spark):
    e = entities(spark, [("a", "A", 1, "x", [], True), ("b", "B", 2, "x", [], True), ("c", "C", 3, "y", ["s"], True), ("d", "D", 4, "z", ["s"], False)])
    assert [tuple(r)[1:] for r in similarity.detect(e).collect()] == [("a", "b", "exact_submission", 0.0)]
    assert {r["id"]: list(r["skipped_layers"]) for r in similarity.exclusions(e).collect()} == {k: ["exact_delta", "minhash_lsh"] for k in "abc"}


def test_threshold_is_inclusive_and_pairs_are_all_found(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        base = [f"s{j}" for j in range(20)] if rng.random() < 0.6 else [f"t{i}{j}" for j in range(12)]
        rows.append((f"d{i:02}", "ABC"[i % 3], i, f"g{i}", sorted({x if rng.random() > 0.12 else f"u{rng.randrange(30)}" for x in base}), False))
    e = entities(spark, rows)
    want = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            x, y = set(a[4]), set(b[4])
            if a[1] != b[1] and len(x & y) / len(x | y) >= 0.7:
                want.add((a[0], b[0]))
    assert {(r["first_id"], r["second_id"]) for r in similarity.exhaustive_pairs(e).collect()} == want and want
    sets = spark.createDataFrame([("l", "x", 7, list(range(7))), ("l", "y", 10, list(range(10)))], "lab_id string, set_id string, n int, hashes array<bigint>")
    assert [r["jaccard"] for r in similarity.similar_sets(sets, 0.7).collect()] == [0.7]


def test_minhash_arithmetic():
    import numpy as np

    values = np.array([0, 1, 59, hashing.PRIME - 1, 2**64 - 1, 2**63, 12345678901234567890], np.uint64)
    for i in (1, 2, 63, 64):
        a, b = hashing.MULTIPLIER * i % hashing.PRIME or 1, hashing.OFFSET * i % hashing.PRIME
        got = hashing._add_mod(hashing._times_mod(a, hashing._reduce(values)), np.full(len(values), b, np.uint64))
        assert [int(x) for x in got] == [(a * int(v) + b) % hashing.PRIME for v in values]


def test_tokens_and_shingles(spark):
    df = spark.createDataFrame([("if(x1>=0xFF && y::z) été=1.5;",)], "t string")
    assert df.select(T.tokens(F.col("t"))).first()[0] == ["if", "(", "x1", ">=", "0", "xFF", "&&", "y", "::", "z", ")", "é", "t", "é", "=", "1.5", ";"] or "0xFF" in df.select(T.tokens(F.col("t"))).first()[0]
    d = spark.createDataFrame([("s", "b.c", "x y"), ("s", "a.c", "z"), ("s", "c.c", "  "), ("t", "a.c", "q")], "submission_id string, path string, added_text string")
    got = {r["submission_id"]: [x.split("\0") for x in r["shingles"]] for r in similarity.shingle_sets(d, 3).collect()}
    assert got["s"][0] == ["__file__", "a.c", "z"] and got["s"][-1] == ["b.c", "x", "y"] and len(got["s"]) == 5
    assert got["t"] == [["__file__", "a.c", "q"]]


FILES = "submission_id string, lab_id string, path string, content string, omission_reason string"
BASE = "lab_id string, path string, content string, revision string, kind string"


def test_delta(spark):
    base = spark.createDataFrame([("l", "a.c", "1\n2\n3\n", "r", "course"), ("l", "b.c", "same\r\nx\n", "r", "course"), ("l", "gone.c", "g\n", "r", "course"), ("l", "other.txt", "o\n", "r", "course")], BASE)
    files = spark.createDataFrame([("s", "l", "a.c", "1\nzwei\n3\n", None), ("s", "l", "b.c", "same\nx\n", None), ("s", "l", "new.c", "n", None), ("s", "l", "cut.c", "c", "file_budget")], FILES)
    rows = {r["path"]: r for r in delta.build(files, base, ["*.c"]).collect()}
    assert set(rows) == {"a.c", "new.c", "gone.c"}
    assert (rows["a.c"]["added_text"], rows["a.c"]["removed_text"]) == ("zwei\n", "2\n")
    assert [tuple(h) for h in rows["a.c"]["hunks"]] == [(1, 3, 1, 3, " 1\n-2\n+zwei\n 3\n")]
    assert rows["new.c"]["baseline_kind"] == "submission_addition" and rows["gone.c"]["removed_text"] == "g\n"
    assert {r["path"] for r in delta.build(files, base).collect()} == {"a.c", "new.c"}
    d = delta.digests(delta.build(files, base), spark.createDataFrame([("s", True), ("none", False)], "submission_id string, incomplete boolean"))
    assert len({r["digest"] for r in d.collect()}) == 2


def test_changes_rebuild_both_sides():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ("".join(rng.choice("abc") + "\n" for _ in range(rng.randint(0, 12))) for _ in range(2))
        c = delta.compare(a, b)
        s = difflib.SequenceMatcher(None, a.splitlines(), b.splitlines(), autojunk=False)
        assert len(a) - len(c["removed_text"]) == len(b) - len(c["added_text"]) == 2 * sum(m.size for m in s.get_matching_blocks())


def test_budgets(spark):
    f = spark.createDataFrame([("s", "a", 4), ("s", "b", 6), ("s", "c", 20), ("s", "d", 4), ("s", "e", 0), ("t", "a", 9)], "submission_id string, path string, size bigint")
    got = {(r["submission_id"], r["path"]): (r["bytes_read"], r["omission_reason"]) for r in bundles.read_budget(f, 8, 18).collect()}
    assert got == {("s", "a"): (4, None), ("s", "b"): (6, None), ("s", "c"): (8, "file_budget"), ("s", "d"): (0, "total_budget"), ("s", "e"): (0, "total_budget"), ("t", "a"): (8, "file_budget")}


@pytest.mark.parametrize(
    "pattern, path, hit",
    [("src/**", "src/a/b.c", True), ("student/*", "student/a/b", False), ("student/*", "student/a", True), ("datasets/*.jsonl", "datasets/x.jsonl", True), ("a?c", "a/c", False), (".env", "xenv", False), ("a", "a\n", False)],
)
def test_globs(spark, pattern, path, hit):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(T.matches_any(F.col("p"), [pattern])).first()[0] is hit


def test_text_functions(spark):
    df = spark.createDataFrame([("#include <a.h>\n  # include \"b/c.hpp\"\n include 'm.fh'\n#define GAUGE 2 // x\n#define EMPTY\n",)], "t string")
    r = df.select(T.includes(F.col("t")).alias("i"), T.definitions(F.col("t")).alias("d")).first()
    assert r["i"] == ["a.h", "b/c.hpp", "m.fh"] and [tuple(x) for x in r["d"]] == [("GAUGE", "2"), ("EMPTY", None)]
    p = spark.createDataFrame([("a/B.C",), ("../x",), ("/x",), ("a//b",), (".env",), ("a\\b",)], "p string")
    assert [r[0] for r in p.select(T.safe_path(F.col("p"))).collect()] == [True, False, False, False, True, False]
    assert [r[0] for r in p.select(T.suffix(F.col("p"))).collect()][:5] == [".c", "", "", "", ""]
    times = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T02:00:00+02:00",), ("2024-01-01T00:00:00",), ("x",)], "t string")
    got = [r[0] for r in times.select(F.unix_seconds(T.utc_instant(F.col("t")))).collect()]
    assert got[0] == got[1] == 1704067200 and got[2:] == [None, None]
    b = spark.createDataFrame([("aGk",), ("aGk=",), ("-_8",)], "b string")
    assert [r[0] for r in b.select(T.base64url(F.col("b"))).collect()] == [bytearray(b"hi"), None, bytearray(b"\xfb\xff")]


def test_catalogue_query():
    q = source.catalogue_query("best_only", 60, "2024-01-01", labs=["l'1"], limit=3)
    assert "b.score >= 60" in q and "'l''1'" in q and q.endswith("LIMIT 3") and "LEFT JOIN" not in q
    assert "LEFT JOIN" in source.catalogue_query("history", 60, "2024-01-01")
    with pytest.raises(ValueError):
        source.catalogue_query("history", 0, "x", limit=0)


def test_whole_audit(spark):
    code = "int main() { return compute(1, 2, 3, 4, 5, 6, 7, 8, 9) + more(10, 11, 12); }\n"
    df = subs(spark, [("a", "A", "l", 90, 1, "da"), ("b", "B", "l", 80, 2, "da"), ("c", "C", "l", 70, 3, "dc"), ("d", "D", "l", 60, 4, "dd")])
    text = {"a": code * 3, "b": code * 3, "c": code * 3 + "x;\n", "d": "template\n"}
    files = spark.createDataFrame([(i, "l", "m.c", len(t), t) for i, t in text.items()], "submission_id string, lab_id string, path string, size bigint, content string")
    base = spark.createDataFrame([("l", "m.c", "template\n", "r", "course")], BASE)
    ledger = spark.createDataFrame([], "review_key string, decision string, confidence double")
    answer = lambda tasks: tasks.select("task_key", F.when(F.col("first_id") == "d", F.lit(None)).otherwise(F.lit("compliant")).alias("decision"), F.lit(0.5).alias("confidence"), F.when(F.col("first_id") == "d", "lost").alias("error"))
    out = audit.run(audit.Request("2024-06-01", limit=None), df, files, base, ledger, answer)
    assert sorted((r["first_id"], r["second_id"], r["signal"]) for r in out.candidates.collect()) == [("a", "b", "exact_submission"), ("a", "c", "minhash"), ("b", "c", "minhash")]
    s = out.summary.first()
    assert (s["tasks"], s["cache_hits"], s["completed"], s["failed"]) == (7, 0, 6, 1)
    stored = out.results.filter("error is null").select("review_key", "identity", "decision", "confidence")
    hits = lambda request, base=base, stored=stored: audit.run(request, df, files, base, stored, answer).summary.first()["cache_hits"]
    assert hits(audit.Request("2024-06-01")) == 6
    # A verdict is found again only under the same versions, model, parameters and baseline.
    for versions in (identity.Versions(rules="2"), identity.Versions(model="other"), identity.Versions(model_parameters=(("temperature", 1),))):
        assert hits(audit.Request("2024-06-01", versions=versions)) == 0
    assert hits(audit.Request("2024-06-01", settings=settings.Settings(permutations=32))) == 3  # pairs rest on it, single ones don't
    assert hits(audit.Request("2024-06-01"), base.withColumn("revision", F.lit("r2"))) == 0
    with pytest.raises(Exception, match="does not have the identity"):
        hits(audit.Request("2024-06-01"), stored=stored.withColumn("identity", F.lit("{}")))
    assert audit.run(audit.Request("2024-06-01", limit=1), df, files, base, ledger, answer).tasks.filter("kind = 'compliance'").count() == 1
    _, _, tasks = audit.plan(audit.Request("2024-06-01", limit=1), df)
    assert sorted(r["kind"] for r in tasks.collect()) == ["compliance", "exact_duplicate"]

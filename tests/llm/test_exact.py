import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tarnwork.llm import exact

from .brute import lowered


def plain(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(lowered(t), []).append(d)
    top = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    return sorted(((d, top[lowered(t)], len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for d, t in rows), key=str)


def got(df, **kw):
    out = exact.marks(df, **kw).collect()
    # One row of each text stays, and it has the doc_id that stays.
    kept = [r for r in out if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in out}) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out), key=str)


def table(n=400, seed=1):
    rng = random.Random(seed)
    texts = ["", "Straße", "STRAßE", "Éa", "éA", "É", "a b", "A B", "a  b", None, "K", "K"]
    rows = [(i, rng.choice(["hot text", "HOT text", "hot TEXT"]) if i % 3 == 0 else rng.choice([*texts, f"text {rng.randrange(80)}", f"only {i}"])) for i in range(n)]
    return rows + [(0, "hot text")] * 3 + [(n - 1, rows[-1][1])] * 2 + [(None, "only here"), (None, "ONLY here"), (None, "hot text")]


def test_against_plain(spark):
    rows = table()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    for counters in (1, 3, 1024):
        assert got(df, counters=counters) == plain(rows)


def test_summaries_keep_their_bound(spark):
    rng = random.Random(4)
    rows = [(bytes([min(255, int(rng.expovariate(0.05)))]),) for _ in range(6000)]
    df = spark.createDataFrame(rows, "digest binary").repartition(5)
    true = Counter(x for x, in rows)
    for counters in (4, 20):
        found = {bytes(r["digest"]): r["n"] for r in exact.summaries(df, counters).groupBy("digest").agg(F.sum("n").alias("n")).collect()}
        assert len(found) <= 5 * counters
        assert all(found.get(x, 0) <= n <= found.get(x, 0) + len(rows) / (counters + 1) for x, n in true.items())


def test_heavy_digests(spark):
    rows = [(b"a", i) for i in range(300)] + [(b"b", i) for i in range(90)] + [(i.to_bytes(2), i) for i in range(310)]
    df = spark.createDataFrame(rows, "digest binary, best bigint").repartition(6)
    found = {bytes(r["digest"]): (r["size"], r["top"]) for r in exact.heavy(df, 9).collect()}
    assert found == {b"a": (300, 299), b"b": (90, 89)}
    assert exact.heavy(df.filter("best < 0"), 9).collect() == []


def test_rows_that_stay_keep_their_columns(spark):
    rows = [(d, t, i, "x") for i, (d, t) in enumerate(table(200, 3))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, size int, _digest string")
    out = exact.deduplicate(df, counters=5)
    assert out.columns == df.columns
    left = [tuple(r) for r in out.collect()]
    assert set(left) <= set(rows)
    top = {s: k for _, k, _, s in plain([r[:2] for r in rows])}
    assert {hashlib.sha256(lowered(t).encode()).hexdigest(): d for d, t, *_ in left} == top and len(left) == len(top)
    assert sorted(left, key=str) == sorted((tuple(r) for r in exact.deduplicate(df.repartition(3)).collect()), key=str)


def test_empty_table_and_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert exact.marks(empty).collect() == [] and exact.deduplicate(empty).collect() == []
    rows = [(1, "Ab é" * 200_000), (2, "aB é" * 200_000), (3, "aB É" * 200_000)]
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == plain(rows)

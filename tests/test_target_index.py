"""The index for one target: the same rows as reading the corpus, additions once, and how much of it is read."""

import datetime as dt
import glob
import os
import random

import pytest

from tarnwork import versions
from tarnwork.operators import similarity, target_index

AT = dt.datetime(2024, 1, 1)
SCHEMA = "id string, owner string, lab_id string, submitted_at timestamp, input_digest string, delta_digest string, shingles array<string>, incomplete boolean, changed_files boolean"


def entities(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed, n=90):
    rng = random.Random(seed)
    common = [f"common{i}" for i in range(6)]
    made, rows = [[f"s{rng.randrange(300)}" for _ in range(30)] for _ in range(6)], []
    for i in range(n):
        s = set(rng.choice(made))
        for _ in range(rng.choice([0, 1, 2, 5, 12])):
            s.discard(rng.choice(sorted(s)))
            s.add(f"s{rng.randrange(300)}")
        s = sorted(s | set(common)) if rng.random() < 0.9 else []
        digest = None if rng.random() < 0.05 else f"d{rng.randrange(20)}"
        rows.append((f"{i:03d}", f"o{rng.randrange(9)}", rng.choice("lm"), AT + dt.timedelta(hours=rng.randrange(40)), digest, f"e{rng.randrange(25)}", s, rng.random() < 0.1, rng.random() < 0.9))
    return rows


def test_the_same_rows_as_from_the_corpus(spark, tmp_path):
    rows = corpus(1)
    df, path = entities(spark, rows), str(tmp_path)
    for i in range(2):
        target_index.add(df.filter(f"cast(id as int) % 2 = {i}"), path, f"part{i}", threshold=0.6, buckets=4 << i)
    signals = set()
    for i in (0, 33, 58):
        target = df.filter(f"id = '{rows[i][0]}'")
        for threshold in (0.6, 0.8):
            want = sorted(map(tuple, similarity.target_against(df, target, threshold).collect()))
            assert sorted(map(tuple, target_index.probe(path, target, threshold).collect())) == want
            signals |= {w[3] for w in want}
    assert signals == {"exact_submission", "exact_delta", "exhaustive_jaccard"}
    new = entities(spark, [("new", "me", "l", AT, "d3", "none", rows[0][6], False, True)])
    assert sorted(map(tuple, target_index.probe(path, new).collect())) == sorted(map(tuple, similarity.target_against(df, new).collect()))
    with pytest.raises(ValueError):
        target_index.probe(path, new, 0.5)
    with pytest.raises(ValueError):
        target_index.probe(path, df.limit(2))


def test_additions_are_done_once(spark, tmp_path):
    df, path = entities(spark, corpus(3, 30)), str(tmp_path)
    assert target_index.probe(path, df.filter("id = '001'")).collect() == []  # nothing is in it yet
    first = target_index.add(df, path, "a")
    assert target_index.add(df, path, "a") == first and len(versions.current(spark, path).parts) == 1
    target_index.add(df.limit(0), path, "empty")
    target_index.add(df.filter("id < '010'"), path, "again")  # members that are there already come once
    target = df.filter("id = '001'")
    assert sorted(map(tuple, target_index.probe(path, target).collect())) == sorted(map(tuple, similarity.target_against(df, target).collect()))


def test_what_a_rare_target_reads_does_not_grow(spark, tmp_path, monkeypatch):
    """A corpus four times as large: bytes in the buckets that a probe reads, and in all. The others are damaged, to be sure."""
    monkeypatch.setattr(target_index, "ROWS", 64)
    inner, read = target_index._lookup, set()

    def lookup(t, path, v, table, keys, *of):
        ((part, note),) = v.parts.items()
        for (b,) in keys.select(target_index._bucket(note["buckets"], *of)).distinct().collect():
            read.update(glob.glob(f"{path}/parts/{part}/{table}/bucket={b}/*.parquet"))
        return inner(t, path, v, table, keys, *of)

    monkeypatch.setattr(target_index, "_lookup", lookup)
    rng, facts = random.Random(4), []
    target = entities(spark, [("t", "me", "l", AT, "x", "y", ["rare1", "rare2", "rare3", "common1"], False, True)])
    for n in (150, 600):
        rows = [(f"{i}", f"o{i % 7}", "l", AT, f"d{i}", f"e{i}", [f"s{rng.randrange(10**6)}" for _ in range(30)] + ["common1", "common2"], False, True) for i in range(n)]
        path = str(tmp_path / str(n))
        target_index.add(entities(spark, rows), path, "all")
        read.clear()
        assert target_index.probe(path, target).collect() == []
        every = glob.glob(f"{path}/parts/*/*/*/*.parquet")
        facts.append((sum(map(os.path.getsize, read)), sum(map(os.path.getsize, every))))
        for f in set(every) - read:
            with open(f, "wb") as out:
                out.write(b"no parquet")
        assert target_index.probe(path, target).collect() == []
    (small, all_small), (large, all_large) = facts
    assert all_large > 3 * all_small and large < 1.5 * small and large < all_large / 10


def test_hashes_are_not_shuffled(spark, tmp_path, monkeypatch):
    """What an addition shuffles, against the bytes of its hashes; before, sets and each of their hashes went several times."""
    monkeypatch.setattr(target_index, "SLOTS", 64)
    rng = random.Random(5)
    rows = [(f"{i}", f"o{i % 7}", "l", AT, f"d{i}", f"e{i}", [f"s{rng.randrange(10**9)}" for _ in range(300)], False, True) for i in range(300)]
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm

    def shuffled():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
        return sum(x.shuffleWriteBytes() for x in jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages))

    before = shuffled()
    target_index.add(entities(spark, rows), str(tmp_path), "all", buckets=4)
    assert 0 < shuffled() - before < 2 * 8 * 300 * 300

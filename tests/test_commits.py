"""The version log and create-only writes: several writers, what is read, no change in place."""

import glob
import os
import threading

import pytest

from tarnwork import sinks, versions


def rows(spark, *x):
    return spark.createDataFrame(x, "k string, v int")


def content(spark, path):
    return sorted(map(tuple, sinks.stored(spark, path).collect()))


def at_once(*jobs):
    """Results, or what was raised, of jobs that begin together."""
    out, gate = [None] * len(jobs), threading.Barrier(len(jobs))

    def one(i, job):
        gate.wait()
        try:
            out[i] = job()
        except Exception as e:
            out[i] = e

    threads = [threading.Thread(target=one, args=x) for x in enumerate(jobs)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def test_one_claim_of_a_version_wins(spark, tmp_path):
    path = str(tmp_path)
    assert versions.current(spark, path) == versions.Version()
    got = at_once(*(lambda i=i: versions.publish(spark, path, versions.Version(), {f"p{i}": {}}) for i in range(6)))
    won = [x for x in got if isinstance(x, versions.Version)]
    assert len(won) == 1 and all(isinstance(x, versions.Lost) for x in got if x not in won)
    assert versions.current(spark, path) == won[0]
    assert not [f for f in os.listdir(f"{path}/versions") if "json" not in f]


def test_writers_of_one_key(spark, tmp_path):
    """Of two contents of a key one is written, whoever was first; equal content is written once."""
    path = str(tmp_path / "t")
    got = at_once(*(lambda i=i: sinks.create_only(rows(spark, ("a", i), (f"own{i}", i)), path, "k") for i in range(3)))
    lost = [x for x in got if isinstance(x, sinks.Conflict)]
    assert len(lost) == 2
    have = content(spark, path)
    assert len(have) == 2 and have[0][1] == have[1][1] and have[1][0] == f"own{have[0][1]}"
    same = str(tmp_path / "s")
    assert all(isinstance(x, versions.Version) for x in at_once(*(lambda: sinks.create_only(rows(spark, ("a", 1), ("b", 2)), same, "k") for _ in range(3))))
    assert content(spark, same) == [("a", 1), ("b", 2)]


def test_writers_of_other_keys_and_nothing_to_do(spark, tmp_path):
    path = str(tmp_path / "t")
    at_once(*(lambda i=i: sinks.create_only(rows(spark, *((f"{i}-{j}", j) for j in range(4))), path, "k") for i in range(4)))
    want = sorted((f"{i}-{j}", j) for i in range(4) for j in range(4))
    before = versions.current(spark, path)
    assert content(spark, path) == want and before.number == 3
    assert sinks.create_only(rows(spark, ("0-0", 0), ("3-2", 2)), path, "k") == before
    assert sinks.create_only(rows(spark, *()), path, "k") == before
    with pytest.raises(sinks.Conflict):
        sinks.create_only(rows(spark, ("new", 1), ("0-0", 7)), path, "k")
    assert content(spark, path) == want and versions.current(spark, path) == before
    parts = {os.path.basename(p) for p in glob.glob(f"{path}/parts/*")}
    assert parts == set(before.parts)  # what lost or failed left nothing behind


def test_only_touched_buckets_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.create_only(rows(spark, *((f"k{i}", i) for i in range(500))), path, "k")
    v = versions.current(spark, path)
    (note,) = v.parts.values()
    assert len(note["buckets"]) == sinks.BUCKETS
    touched = spark.createDataFrame([("k7",)], "k string").select(sinks._bucket("k", sinks.BUCKETS)).first()[0]
    assert [p.rsplit("/", 1)[1] for p in sinks._key_paths(path, v.parts, [touched])] == [f"key_bucket={touched}"]
    # Damage in buckets that a row does not touch is not met; in its own it is.
    for p in glob.glob(f"{path}/parts/*/keys/key_bucket=*/*.parquet"):
        if f"key_bucket={touched}/" not in p:
            with open(p, "wb") as f:
                f.write(b"no parquet")
    assert sinks.create_only(rows(spark, ("k7", 7)), path, "k") == v
    with pytest.raises(sinks.Conflict):
        sinks.create_only(rows(spark, ("k7", 8)), path, "k")


def test_parts_are_put_together_and_expire(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "MOST_PARTS", 4)
    path = str(tmp_path / "t")
    for i in range(6):
        sinks.create_only(rows(spark, (f"k{i}", i)), path, "k")
    v = versions.current(spark, path)
    assert len(v.parts) == 3 and content(spark, path) == [(f"k{i}", i) for i in range(6)]
    old = versions.read(spark, path, 2)
    assert sinks.stored(spark, path, old).count() == 3  # a reader of an old version still has it
    gone = versions.expire(spark, path, keep=1)
    assert set(gone) == {p for n in range(v.number) for p in versions.read(spark, path, n).parts} - set(v.parts)
    assert content(spark, path) == [(f"k{i}", i) for i in range(6)]
    with pytest.raises(sinks.Conflict):
        sinks.create_only(rows(spark, ("k0", 5)), path, "k")
    with pytest.raises(versions.Lost):
        versions.publish(spark, path, versions.read(spark, path, 1), {})


def test_events_of_one_run_by_two_writers(spark, tmp_path):
    ev = lambda *x: spark.createDataFrame(x, "run_id string, state string, updated_at int")
    path = str(tmp_path / "e")
    got = at_once(*(lambda i=i: sinks.append_events(ev(("r", "queued", i), (f"own{i}", "queued", i)), path, ("queued",)) for i in range(3)))
    assert all(isinstance(x, versions.Version) for x in got)
    have = sorted((r["run_id"], r["sequence"]) for r in sinks.stored(spark, path).collect())
    assert have == [("own0", 1), ("own1", 1), ("own2", 1), ("r", 1), ("r", 2), ("r", 3)]

"""Streams with state: due runs by timers, bounded queues, the latest index; restarts go on where they were."""

import random
import time

from pyspark.sql import functions as F

from tarnwork import versions
from tarnwork.operators import reports, runs
from tarnwork.streaming import latest, run_states, stateful

EVENT = "run_id string, sequence bigint, state string, updated_at bigint, error_code string, source string"


def wait(query, done, seconds=90):
    end = time.time() + seconds
    while not done() and time.time() < end:
        assert query.exception() is None, query.exception()
        time.sleep(0.2)
    query.stop()
    assert done()


def run_events(seed=1, n=36):
    rng, rows = random.Random(seed), []
    for i in range(n):
        source, state, seq = rng.choice(["manual", "nightly"]), "queued", 1
        rows.append((f"r{i:02d}", seq, state, seq * 100 + i, None, source))
        for _ in range(rng.randint(1, 2)):
            for state in ("preparing", "failed"):
                seq += 1
                error = rng.choice([*runs.RETRYABLE, *runs.MANUAL_RETRYABLE, "OTHER"]) if state == "failed" else None
                rows.append((f"r{i:02d}", seq, state, seq * 100 + i, error, source))
            if rng.random() < 0.3:
                rows.append((f"r{i:02d}", seq + 1, "completed", seq * 100 + 150 + i, None, source))
                break
    return rng.sample(rows, len(rows))


def test_due_runs_are_those_of_the_batch(spark, tmp_path):
    """Shuffled events in several files; the first tick's choice is the batch's, a restart goes on with the others."""
    rows = run_events()
    source = str(tmp_path / "events")
    put = lambda some: spark.createDataFrame(some, EVENT).coalesce(1).write.mode("append").parquet(source)
    for i in range(0, len(rows), 20):
        put(rows[i : i + 20])
    every = spark.createDataFrame(rows, EVENT)
    first = every.groupBy("run_id").agg(F.max("source").alias("source"))
    current = runs.current(every).join(first, "run_id")
    for newest in (True, False):
        want = [r["run_id"] for r in runs.reconcile(current, 3, newest).collect()]
        after = [r["run_id"] for r in runs.reconcile(current, 6, newest).collect()][3:]
        assert len(want) == 3 and (after or not newest)
        events = lambda: spark.readStream.schema(EVENT).parquet(source)
        got: list[list[str]] = []
        spot = str(tmp_path / f"state-{newest}")

        def requeue(chosen, got=got):
            got.append([r["run_id"] for r in chosen.collect()])

        start = lambda requeue=requeue, spot=spot, newest=newest: stateful.reconcile(events(), spot, requeue, 3, newest, every=2.0)
        wait(start(), lambda: bool(got))
        assert got[0] == want
        # What was handed out is queued again: those runs are due no more, and after a restart the next ones are.
        last = {r["run_id"]: r for r in current.collect()}
        if newest:
            got.clear()
            put([(x, last[x]["sequence"] + 1, "queued", 10_000, None, None) for x in want])
            wait(start(), lambda: any(x == after for x in got))
            put([(x, last[x]["sequence"] + 2, "failed", 10_000, "OTHER", None) for x in want])
            current = current.filter(~F.col("run_id").isin(want))


def plain_queue(batches, room):
    depth, known, out = {}, {}, []
    for rows in batches:
        for q in sorted({r[0] for r in rows}):
            for _, run, kind, at in sorted((r for r in rows if r[0] == q), key=lambda r: (r[3], r[2], r[1])):
                seen, n = known.get((q, run)), depth.get(q, 0)
                if kind == "finished":
                    if seen != "in":
                        continue
                    known[q, run], n, outcome = "done", n - 1, "finished"
                elif n >= room:
                    outcome = "full"
                elif seen:
                    outcome = "known"
                else:
                    known[q, run], n, outcome = "in", n + 1, "admitted"
                depth[q] = n
                out.append((q, run, at, outcome, n))
    return out


def test_bounded_queue_over_batches(spark, tmp_path):
    rng, source, batches = random.Random(6), str(tmp_path / "requests"), []
    spot, got = str(tmp_path / "spot"), {}
    schema = "queue string, run_id string, kind string, at bigint"
    for b in range(4):
        some = [(rng.choice("ab"), f"r{rng.randrange(30)}", rng.choice(["request", "request", "finished"]), 1000 * b + rng.randrange(60)) for _ in range(40)]
        batches.append(list(set(some)))
        spark.createDataFrame(rng.sample(batches[-1], len(batches[-1])), schema).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        # A stream of its own for each batch, on one checkpoint.
        q = stateful.start_admission(stream, 5, spot, lambda rows, n: got.__setitem__(n, [tuple(r) for r in rows.collect()]))
        q.awaitTermination()
    want = plain_queue(batches, 5)
    assert sorted(x for n in sorted(got) for x in got[n]) == sorted(want)
    assert {x[3] for x in want} == {"admitted", "known", "full", "finished"}


class Held:
    """A state of the handle's, whose calls are counted."""

    def __init__(self):
        self.at, self.calls = {}, 0

    def _call(self, x):
        self.calls += 1
        return x

    def exists(self):
        return self._call(None in self.at)

    def containsKey(self, key):
        return self._call(key in self.at)

    def get(self):
        return self._call(self.at[None])

    def getValue(self, key):
        return self._call(self.at[key])

    def update(self, value):
        self.at[None] = self._call(value)

    def updateValue(self, key, value):
        self.at[key] = self._call(value)


def test_a_large_queue_in_few_calls(monkeypatch):
    """Chunks that grow over batches: the plain queue's rows, by fewer calls to the state than there are runs."""
    monkeypatch.setattr(stateful, "TOGETHER", 8)
    rng, q, batches = random.Random(8), stateful._Queue(40), []
    q.held, q.runs = Held(), Held()
    for b in range(3):
        batches.append(list({("a", f"r{rng.randrange(2500)}", rng.choice(["request", "finished"]), 1000 * b + rng.randrange(900)) for _ in range(6000)}))
    got = [tuple(r) for rows in batches for r in q.handleInputRows(("a",), iter([{"run_id": r, "kind": k, "at": at} for _, r, k, at in rows]), None)]
    assert got == plain_queue(batches, 40)
    assert len(q.runs.at) > 16 and q.runs.calls + q.held.calls < len({x[1] for x in got}) < len(got)


REPORT = "submission_id string, counterpart_id string, completed_at bigint, review_key string, decision string"
KEYS = ("submission_id", "counterpart_id")


def test_latest_index_after_each_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(latest, "MOST", 3)
    rng, path, all_rows = random.Random(2), str(tmp_path), []
    for b in range(5):
        rows = [(f"s{rng.randrange(8)}", f"c{rng.randrange(4)}", rng.randrange(100), f"k{b}-{i}", rng.choice("xy")) for i in range(25)]
        all_rows += rows
        v = latest.upsert(spark.createDataFrame(rows, REPORT), path, KEYS, number=b)
        assert v.number == b and len(v.parts) <= 3
        assert latest.upsert(spark.createDataFrame(rows[:3], REPORT), path, KEYS, number=b) == v  # the same batch again
        want = sorted(map(tuple, reports.latest(spark.createDataFrame(all_rows, REPORT), *KEYS).collect()))
        assert sorted(map(tuple, latest.generation(spark, path, KEYS).collect())) == want
    old = versions.read(spark, path, 2)
    assert latest.generation(spark, path, KEYS, version=old).count() > 0
    parts = {p for n in range(5) for p in versions.read(spark, path, n).parts}
    assert set(versions.expire(spark, path, keep=1)) == parts - set(versions.current(spark, path).parts)
    assert sorted(map(tuple, latest.generation(spark, path, KEYS).collect())) == want


def test_a_reader_stays_with_its_generation(spark, tmp_path):
    path, now = str(tmp_path), [0.0]
    put = lambda *rows: latest.upsert(spark.createDataFrame(rows, REPORT), path, KEYS)
    view = latest.Refreshed(spark, path, KEYS, seconds=30, clock=lambda: now[0])
    assert view.get() is None
    put(("s", "c", 1, "k1", "x"))
    now[0] = 29
    assert view.get() is None
    now[0] = 30
    assert view.get().first()["review_key"] == "k1"
    put(("s", "c", 2, "k2", "x"), ("s", "d", 3, "k3", "y"))
    assert view.get().count() == 1
    now[0] = 61
    assert [r["review_key"] for r in latest.by_subject(view.get()).first()["reports"]] == ["k3", "k2"]


def test_old_rows_go_when_parts_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(latest, "MOST", 1)
    for i, at in enumerate((5, 50, 60)):
        latest.upsert(spark.createDataFrame([(f"s{i}", "c", at, "k", "x")], REPORT), str(tmp_path), KEYS, alive=F.col("completed_at") >= 10)
    assert sorted(r["submission_id"] for r in latest.generation(spark, str(tmp_path), KEYS).collect()) == ["s1", "s2"]


def test_requests_are_created_once(spark, tmp_path):
    """The same payload in two batches, and twice in one, makes one run."""
    source, out, spot = (str(tmp_path / x) for x in ("in", "out", "spot"))
    schema = "payload string, created_at timestamp"
    for day, payloads in ((1, ["a", "b", "a"]), (1, ["b", "c"])):
        rows = spark.createDataFrame([(p, f"2024-01-0{day} 00:00:0{i}") for i, p in enumerate(payloads)], "payload string, at string")
        rows.select("payload", F.col("at").cast("timestamp").alias("created_at")).coalesce(1).write.mode("append").parquet(source)
        made = run_states.created_once(spark.readStream.schema(schema).parquet(source))
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", spot).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).collect()
    assert sorted(r["payload"] for r in got) == ["a", "b", "c"] and len({r["run_id"] for r in got}) == 3

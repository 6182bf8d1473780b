import math
import random
import re

import pytest

from tarnwork.llm import mixing

from .brute import spark_hash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights, factor, most):
    """Shares of factor times all sizes by weight, none above most times its own; what is cut off is shared again."""
    left, free, out = factor * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = {i for i in free if unit * weights[i] > most * sizes[i]}
        for i in over or free:
            out[i] = most * sizes[i] if over else unit * weights[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        free -= over
    return out


def plain(rows, weights=(3, 1, 2), factor=1.5, most=2.0):
    """Facts of each row and all pieces (slot, sid, doc_id, epoch, start, length), by the schedule as the contract tells it."""
    docs, seen = [], {}
    for d, t, s in rows:
        key = (d, s, t)
        seen[key] = seen.get(key, -1) + 1
        docs.append((d, t, s, len(WORD.findall(t or "")), seen[key]))
    names = sorted({s for *_, s, _, _ in docs}, key=lambda s: (s is None, (s or "").encode()))
    of = {s: [x for x in docs if x[2] == s] for s in names}
    sizes = [sum(x[3] for x in of[s]) for s in names]
    goal = plain_targets(sizes, [weights[i % len(weights)] for i in range(len(names))], factor, most)
    take = [round(t) for t in goal]
    total = sum(take)
    bits = max(12, math.ceil(math.log2(max(1, total / 1024))))
    slots, done, pieces, got = 1 << bits, 0, [], {}
    reverse = lambda p: int(format(p, f"0{bits}b")[::-1], 2)
    for i, s in enumerate(names):
        first, end = -(-done * slots // max(1, total)), -(-(done + take[i]) * slots // max(1, total))
        done += take[i]
        if not take[i]:
            continue
        mine = sorted((reverse(p), p) for p in (range(first, end) if end > first else [min(first, slots - 1)]))
        block = -(-take[i] // len(mine))
        stretches = max(1, -(-len(of[s]) // mixing.STRETCH))
        name = lambda x: (spark_hash(x[0], spark_hash(x[1]), x[4], (29, 4)), x[0] is not None, x[0] or 0, spark_hash(x[1]), x[4])
        order = sorted((x for x in of[s] if x[3]), key=lambda x: ((name(x)[0] >> 20) % stretches, *name(x)))
        at = 0
        for epoch in range(-(-take[i] // sizes[i])):
            for x in order:
                for j in range(x[3]):
                    if at < take[i]:
                        got.setdefault((i, at // block, x[0], x[1], x[4], epoch), []).append(j)
                        at += 1
        pieces += [(mine[r][0], sid, d, e, js[0], len(js)) for (sid, r, d, t, c, e), js in got.items() if sid == i]
    return docs, names, sizes, goal, sorted(pieces, key=str)


def cases():
    rng = random.Random(2)
    mixed = [(i, " ".join("w" * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", None, "Z"])) for i in range(300)]
    mixed += [(7, "x y", "a")] * 2 + [(8, None, "a"), (9, "\x0b \x1c", "é"), (None, "no id", "a"), (None, "no id", "a")]
    hosts = [(i, "w " * rng.randint(1, 9), f"host{rng.randrange(400)}.example") for i in range(2500)]
    long = [(1, "very long " * 60_000, "a"), (2, "b " * 40, "b"), (3, "", "c")]
    hot = [(i, f"w{i} " * 5, "hot") for i in range(2600)] + [(5000 + i, "x y z", "cold") for i in range(20)]
    return {"mixed": mixed, "hosts": hosts, "long": long, "hot": hot}


@pytest.mark.parametrize("name", list(cases()))
def test_schedule_against_a_plain_one(spark, name):
    rows = cases()[name]
    docs, names, sizes, goal, want = plain(rows)
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id bigint, text string, source string, size int, _n string")
    measured = mixing.measured(df)
    plan = mixing.plan_sources(measured)
    assert [(r["source"], r["source_size"]) for r in plan.orderBy("sid").collect()] == list(zip(names, sizes))
    assert [r["target"] for r in plan.orderBy("sid").collect()] == pytest.approx(goal)
    got = sorted(((p["slot"], p["sid"], p["doc_id"], p["epoch"], p["start"], p["length"]) for p in mixing.mix(measured, plan).collect()), key=str)
    assert got == want
    rows_out = mixing.taken(df).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows_out) == sorted((x[0] or -1, x[3]) for x in docs)
    assert all(r["taken"] <= 2 * r["size"] and (r["first_slot"] is None) == (r["taken"] == 0) for r in rows_out)
    assert sum(r["taken"] for r in rows_out) == sum(map(round, goal))
    again = mixing.taken(df).collect()
    assert sorted(map(str, rows_out)) == sorted(map(str, again))


def test_schedule_is_even(spark):
    df = spark.createDataFrame([(i, "w " * 50, "ab"[i % 2]) for i in range(200)], "doc_id bigint, text string, source string")
    rows = mixing.measured(df)
    plan = mixing.plan_sources(rows)
    pieces, goal = mixing.mix(rows, plan).collect(), [r["target"] for r in plan.orderBy("sid").collect()]
    most = max(p["slot"] for p in pieces) + 1
    half = [p for p in pieces if p["slot"] < most // 2]
    assert abs(sum(p["length"] for p in half if p["sid"] == 0) / sum(p["length"] for p in half) - goal[0] / sum(goal)) < 0.01


def test_targets(spark):
    def of(sizes, weights):
        rows = spark.createDataFrame([(i, f"s{i}", n, 0, 0) for i, n in enumerate(sizes)], "doc_id bigint, source string, size bigint, text_hash bigint, copy bigint")
        return [r["target"] for r in mixing.plan_sources(rows, weights).orderBy("sid").collect()]

    assert of([10, 10, 10], [3, 1, 2]) == pytest.approx([20, 25 / 3, 50 / 3])
    assert of([1, 100], [3, 1]) == [2, 149.5] and of([0, 0], [3, 1]) == [0, 0] and of([], [1]) == []


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.taken(df).collect() == []

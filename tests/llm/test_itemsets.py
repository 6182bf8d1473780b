import random

import pytest

from tarnwork.llm import itemsets

from . import brute


def mined(spark, rows, schema="sale bigint, item bigint", **kw):
    df = spark.createDataFrame(rows, schema)
    m = itemsets.closed(df, "sale", "item", **kw)
    return m, itemsets.with_rules(m, itemsets.rules(m)).collect()


def plain(rows, **kw):
    out = []
    for x, (s, rules) in brute.itemsets(rows, **kw).items():
        best = min(((a, c) for c, (a, _) in rules.items()), default=(None, None))[1]
        out.append((",".join(map(str, x)), len(x), s, len(rules), best, ";".join(f"{c}:{a}:{o}" for c, (a, o) in sorted(rules.items()))))
    return sorted(out, key=str)


def random_rows(seed, baskets=120, items=14):
    rng = random.Random(seed)
    bundles = [rng.sample(range(items), rng.randint(2, 5)) for _ in range(4)]
    rows = []
    for b in range(baskets):
        some = set(rng.choice(bundles)) if rng.random() < 0.7 else set()
        some |= {rng.randrange(items) for _ in range(rng.randint(0, 3))}
        rows += [(b, i) for i in some if rng.random() < 0.95]
    return rows + rng.choices(rows, k=40) + [(None, 3), (4, None), (9_999, None)]


@pytest.mark.parametrize("seed", (1, 2))
def test_against_all_subsets(spark, seed):
    rows = random_rows(seed)
    assert sorted(map(tuple, mined(spark, rows)[1]), key=str) == plain(rows)


def test_items_of_all_baskets_and_ids_that_sort_by_number(spark):
    """Items 2 and 10 are in every basket: the set of nothing has them as its closure."""
    rows = [(b, i) for b in range(12) for i in (2, 10, *([100] if b % 2 else []), *([7, 30] if b < 6 else []))]
    got = sorted(map(tuple, mined(spark, rows)[1]), key=str)
    assert got == plain(rows) and ("2,10", 2, 12) in [r[:3] for r in got] and ("2,7,10,30", 4, 6) in [r[:3] for r in got]


def test_large_baskets_are_looked_up(spark, monkeypatch):
    """Two baskets hold all items; what they add is the same as if they had been expanded."""
    monkeypatch.setattr(itemsets, "LOOKED_UP", 0)
    rows = random_rows(3, items=30) + [(b, i) for b in (500, 501) for i in range(30)]
    aside = []
    inner = itemsets._aside
    monkeypatch.setattr(itemsets, "_aside", lambda *a: aside.append(inner(*a)) or aside[-1])
    assert sorted(map(tuple, mined(spark, rows)[1]), key=str) == plain(rows)
    assert aside == [16]


def test_least_support_follows_the_baskets(spark):
    rows = [(b, i) for b in range(60) for i in ((1, 2) if b < 6 else (3,))]
    m, got = mined(spark, rows, share=10)
    assert m.least == 6 and sorted(map(tuple, got), key=str) == plain(rows, share=10)
    assert mined(spark, rows, share=8)[1][0]["items"] == "3"


def test_nothing_to_find_and_clashing_names(spark):
    assert mined(spark, [])[1] == [] and mined(spark, [(1, 1), (None, 2)])[1] == []
    rows = [(b, i, "x", 1.5) for b in range(6) for i in (1, 2)]
    df = spark.createDataFrame(rows, "`sale.id` bigint, items bigint, basket string, n double")
    m = itemsets.closed(df, "sale.id", "items")
    assert [tuple(r)[:4] for r in itemsets.with_rules(m, itemsets.rules(m)).collect()] == [("1,2", 2, 6, 0)]
    words = spark.createDataFrame([(b, i) for b in range(6) for i in ("b", "a")], "sale bigint, item string")
    m = itemsets.closed(words, "sale", "item")
    assert [r["items"] for r in m.sets.collect()] == [["a", "b"]]

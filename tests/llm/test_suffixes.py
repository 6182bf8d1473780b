import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import suffixes

from . import brute


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(tuple(r)[:5] for r in suffixes.deduplicate(df, **kw).drop("spans").collect())


def test_planted_repeats(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(20, 200)))
    passages = [word() for _ in range(6)]
    rows = [(i, "".join(rng.choice([word(), rng.choice(passages), "ab" * 40]) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "x" * 300), (63, "x" * 300), (64, "x" * 49)]
    assert got(spark, rows, batch_bytes=3000) == brute.suffixes(rows)


def test_repeated_rows_and_extra_columns(spark):
    rows = [(7, "a quick brown fox jumps over the lazy dog, and again " * 2, 1)] * 2 + [(9, "zz a quick brown fox jumps over the lazy dog, and again", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _batch int")
    assert sorted(tuple(r)[:5] for r in suffixes.deduplicate(df).drop("spans").collect()) == brute.suffixes([r[:2] for r in rows])
    df = df.withColumns({"blob": F.lit(1), "_range": F.lit("r"), "spans": F.lit(2.5)})
    kept = suffixes.deduplicate(df, keep_columns=True)
    assert kept.columns == ["doc_id", "text", "_batch", "blob", "_range", "spans"] and sorted(r["_batch"] for r in kept.collect()) == [1, 1, 2]


def test_rows_without_ids_and_long_texts(spark):
    """Rows without an id cut nothing of each other, wherever they are dealt; texts of several chunks are cut whole."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefg ") for _ in range(120))
    long = "".join(rng.choice("abcdefghij ") for _ in range(2 * suffixes.CHUNK + 1000))
    rows = [(None, f"{i} {passage} tail {i}") for i in range(12)] + [(4, passage), (9, long), (8, long[suffixes.CHUNK - 400 : suffixes.CHUNK + 400]), (7, passage * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r)[:5] for r in suffixes.deduplicate(df, batch_bytes=2000).drop("spans").fillna(10**9, ["doc_id"]).collect())
    small = [(d if d is not None else 10**9, t) for d, t in rows if d != 9]
    want = brute.suffixes(small)
    assert [r for r in got if r[0] != 9] == want
    cut = next(r for r in got if r[0] == 9)
    kept = long[: suffixes.CHUNK - 400] + long[suffixes.CHUNK + 400 :]
    assert cut[1:] == (len(long), 800, 1, hashlib.sha256(kept.encode()).hexdigest())


def ranges(spark, monkeypatch, rows, n):
    """Facts of the rows, and bytes of each of n ranges of leading strings."""
    df, taken = spark.createDataFrame(rows, "doc_id bigint, text string"), []
    inner = type(df).groupBy
    with monkeypatch.context() as m:
        m.setattr(type(df), "groupBy", lambda self, *c: (taken.append(self) if c == ("_range",) else None, inner(self, *c))[1])
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        found = suffixes.deduplicate(df)
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = sorted((tuple(r)[:5] for r in found.drop("spans").collect()), key=str)
    return got, [r["n"] for r in taken[1].groupBy("_range").agg(F.sum(F.length("blob")).alias("n")).collect()]


def test_a_hot_phrase_is_dealt_to_many_ranges(spark, monkeypatch):
    """A phrase under the span, between words that differ: its segments are all different and share their anchors."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    rows = []
    for i in range(120):
        some = [f"{word()} {word()} all rights reserved worldwide {word()} {word()} {word()}" for _ in range(40)]
        rows.append((i, " ".join(some + ([rows[i - 1][1][200:900]] if i % 5 == 4 else []))))
    got, sizes = ranges(spark, monkeypatch, rows, 32)
    assert got == sorted(brute.suffixes(rows), key=str) and any(r[2] for r in got)
    assert len(sizes) > 20 and max(sizes) < 4 * sum(sizes) / len(sizes)


def test_rows_without_ids_are_sampled(spark, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    passages = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(700)]
    rows = [(None, rng.choice(passages) + " " + rng.choice(passages)) for _ in range(1500)]
    _, sizes = ranges(spark, monkeypatch, rows, 16)
    assert len(sizes) == 16 and max(sizes) < 3 * sum(sizes) / len(sizes)


@pytest.mark.parametrize("span", [17, 30, 100, 122])
def test_other_spans(spark, span):
    rng = random.Random(span)
    passages = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(20, 400))) for _ in range(8)]
    rows = [(i, "".join(rng.choice([*passages, "xyz" * rng.randint(1, 60), str(rng.random())]) for _ in range(rng.randint(0, 5)))) for i in range(50)]
    assert got(spark, rows, span=span) == brute.suffixes(rows, span)


@pytest.mark.parametrize("span", [16, 123, 200])
def test_spans_that_do_not_fit(spark, span):
    with pytest.raises(ValueError):
        suffixes.deduplicate(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), span=span)


def test_empty(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize("n", [1, 50, 400])
def test_multikey_sort_is_a_sort(n):
    rng = np.random.default_rng(n)
    flat = rng.integers(97, 99, n + 60, dtype=np.uint8).tobytes()
    starts = rng.permutation(n)
    order, group = suffixes.multikey_sort(suffixes._words(flat + bytes(16)), starts, 50)
    cut = [flat[s : s + 50] for s in starts[order]]
    assert cut == sorted(cut)
    assert len(group) == len(set(cut))

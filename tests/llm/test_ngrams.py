import random

import pytest

from tarnwork.llm import ngrams

from . import brute


def corpus(seed, n=80):
    rng = random.Random(seed)
    vocab = [f"W{i}" for i in range(60)]
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.7:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        else:
            t = " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 12, 40, 90])))
        texts.append(t)
        rows.append((i * 3, rng.choice([t, t.lower(), t.replace(" ", "\n\t")])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "é É"), (1006, "é é")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, ngrams.join(df, 3, 90, 100).drop("text_hash", "label").collect())) == brute.jaccard(rows)


def test_star_of_near_copies(spark):
    """Copies that are linked with one text, but mostly not with each other."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(130)]
    rows = [(0, " ".join(base))]
    for i in range(1, 30):
        w = list(base)
        for j in rng.sample(range(130), 2):
            w[j] = f"x{i}{j}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, ngrams.join(df, 3, 90, 100).drop("text_hash", "label").collect())) == brute.jaccard(rows)


@pytest.mark.parametrize("seed", range(3))
def test_crowd_of_copies_with_more_and_fewer_edits(spark, seed):
    """Many copies outside the hub's component, some linked with each other."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    made, rows = [list(base)], []
    for i in range(150):
        w = list(rng.choice(made) if rng.random() < 0.3 else base)
        for j in rng.sample(range(len(w)), rng.choice([1, 1, 2, 3, 4, 6])):
            w[j] = f"x{rng.randrange(200)}"
        if rng.random() < 0.2:
            w = w[: -rng.randint(1, 8)]
        made.append(w)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute.jaccard(rows)
    assert 5 < len({c for _, _, c in want}) < 140
    assert sorted(map(tuple, ngrams.join(df, 3, 90, 100).drop("text_hash", "label").collect())) == want


def test_repeated_rows_extra_columns_and_empty(spark):
    rows = [(5, "a b c d", 1, 2)] * 2 + [(2, "A B C D", 3, 4), (None, "a b c d", 5, 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, node int, label int")
    got = sorted(map(tuple, ngrams.join(df).drop("text_hash", "label").collect()), key=str)
    assert got == sorted([(5, 1, 2), (5, 1, 2), (2, 1, 2), (None, 1, 2)], key=str)
    assert ngrams.join(df.limit(0)).collect() == []


def test_long_texts_and_a_large_family(spark, monkeypatch):
    """Texts over the size that powers are kept for, and a family of several shares of its hub."""
    rng = random.Random(7)
    long = [f"w{rng.randrange(90_000)}" for _ in range(190_000)]
    near = list(long)
    for i in range(0, 6000):
        near[i * 30] = "other"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[: len(long) // 2]))]
    assert len(rows[0][1]) > 1 << 20
    base = [f"b{i}" for i in range(200)]
    for i in range(10, 90):
        w = list(base)
        for j in rng.sample(range(200), rng.choice([0, 1, 2, 4])):
            w[j] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(ngrams, "FAMILY", 7)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, ngrams.join(df, 3, 90, 100).drop("text_hash", "label").collect())) == brute.jaccard(rows)


@pytest.mark.parametrize("size, clusters", [(150, 2), (70, 4)])
def test_clusters_that_are_not_linked(spark, monkeypatch, size, clusters):
    """Clusters of near copies in one family, under the threshold from each other: members of one are not tried in pairs."""
    rng = random.Random(size)
    base, rows = [f"w{i}" for i in range(160)], []
    for c in range(clusters):
        middle = list(base)
        for j in rng.sample(range(0, 160, 8), 7):
            middle[j] = f"c{c}x{j}"
        for i in range(size):
            w = list(middle)
            w[rng.randrange(160)] = f"e{c}x{i}"
            rows.append((1000 * c + i, " ".join(w)))
    seen, inner = {}, ngrams.staged

    def counted(df, label):
        out = inner(df, label)
        if label in ("ngram-tries", "ngram-prefixes"):
            seen[label] = out.count()
        return out

    monkeypatch.setattr(ngrams, "staged", counted)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, ngrams.join(df, 3, 90, 100).drop("text_hash", "label").collect()))
    assert got == brute.jaccard(rows) and len({c for *_, c in got}) == clusters
    assert seen.get("ngram-tries", 0) <= size * clusters, seen


def test_labels_part_components_without_ids(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (None, "A B C D E F G"), (None, "h i j k l m"), (None, "")]
    got = ngrams.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r["component_id"] is None for r in got) and len({r["label"] for r in got}) == 3

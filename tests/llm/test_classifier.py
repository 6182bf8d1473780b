import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tarnwork.llm import classifier


def test_isotonic():
    at, to = classifier.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert to.tolist() == [0, 0.5, 1] and at.tolist() == [1, 2.5, 4]


def test_learns_and_scores_all(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(400):
        good = i % 3 > 0
        words = [rng.choice(["the", "of", "plain", "words", "here"]) if good else rng.choice(["BUY", "NOW!!", "$$$", "##"]) for _ in range(rng.randint(5, 80))]
        rows.append((i, " ".join(words), 0))
        marks.append((i, int(good), 0))
    rows += [(1000, None, 0), (1001, "", 0), (None, "the words", 0), (1002, "x" * 5000, 0), (1002, "x" * 5000, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    got = classifier.classify(docs, labels).collect()
    assert len(got) == len(rows)
    truth = {d: q for d, q, _ in marks}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert sorted(map(str, classifier.classify(docs, labels).collect())) == sorted(map(str, got))
    assert {r["score"] for r in classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert classifier.classify(docs.limit(0), labels).collect() == []


def test_statistics_do_not_depend_on_neighbours():
    texts = [b"Hello world!\nHello world!\n", b"", b"A b c", b" \n", "é ü".encode(), b"x"]
    whole = classifier.statistics(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]))
    alone = np.concatenate([classifier.statistics(np.frombuffer(t, np.uint8), np.array([len(t)])) for t in texts])
    assert np.allclose(whole, alone)


def plain_statistics(text):
    """The statistics of one text, by plain counting."""
    raw = (text or "").encode()
    some = max(1, len(raw))
    out, rest = [], set(range(256))
    for members in classifier._CLASSES.values():
        out.append(sum(b in members for b in raw) / some)
        rest -= set(members)
    out.append(sum(b in rest for b in raw) / some)
    lines = [[w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", x)] for x in raw.split(b"\n")]
    lines = [x for x in lines if x]
    words = [w for x in lines for w in x]
    n = max(1, len(words))
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    spaces = sum(b in b" \t\n\r\x0b\x0c" for b in raw)
    out += [math.log1p(len(words)), (len(raw) - spaces) / n, len(set(words)) / n, max(Counter(words).values(), default=0) / n, len(set(triples)) / max(1, len(triples))]
    out += [len({tuple(sorted(x)) for x in lines}) / max(1, len(lines)), len(words) / max(1, len(lines)) / 50, math.log1p(len(raw)), float(len(words) < 20)]
    return out


def test_scores_against_a_plain_fit(spark):
    rng = random.Random(5)
    text = lambda good: "\n".join(" ".join(rng.choice(["the", "of", "É", "a,", "so."] if good else ["BUY", "$$$", "of", "9!"]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 4)))
    rows = [(i, text(i % 3 > 0) if i % 17 else None) for i in range(260)]
    marks = {i: int(i % 3 > 0) for i in range(0, 260) if i % 4}
    fold = lambda d: zlib.crc32(str(d).encode()) % 5
    x = np.array([plain_statistics(t) for _, t in rows])
    known = [i for i, (d, _) in enumerate(rows) if d in marks and fold(d)]
    mean, std = x[known].mean(axis=0), x[known].std(axis=0)
    std[std <= 1e-9] = 1
    d, m = x.shape[1], classifier.FEATURES
    draws = np.random.default_rng(classifier.SEED)
    w, b = draws.normal(0, 1 / np.sqrt(2 * d), (d, m)), draws.uniform(0, 2 * np.pi, m)
    z = np.hstack([np.sqrt(2 / m) * np.cos(np.clip((x - mean) / std, -8, 8) @ w + b), np.ones((len(x), 1))])
    y = np.array([marks.get(i, 0) for i, _ in rows], float)
    use = [i for i in known if fold(rows[i][0]) != 1]
    penalty = np.diag([classifier.RIDGE] * m + [1e-6])
    raw = z @ np.linalg.solve(z[use].T @ z[use] + penalty, z[use].T @ y[use])
    held = sorted((raw[i], y[i]) for i in known if fold(rows[i][0]) == 1)
    # Isotonic means, plainly: the largest of all least averages of stretches around each place.
    s, t = np.array([h[0] for h in held]), [h[1] for h in held]
    level = [max(min(sum(t[i : j + 1]) / (j + 1 - i) for j in range(k, len(t))) for i in range(k + 1)) for k in range(len(t))]
    levels = sorted(set(np.round(level, 9)))
    centre = [np.mean([a for a, v in zip(s, level) if round(v, 9) == u]) for u in levels]
    want = np.clip(np.interp(raw, centre, levels), 0, 1)
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, q, 0) for i, q in marks.items()], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in classifier.classify(docs, labels).collect()}
    assert max(abs(got[i] - want[k]) for k, (i, _) in enumerate(rows)) < 1e-5


def test_more_labelled_rows_than_are_fitted(spark):
    """A bound under the labelled rows: so many are taken, the same again however the rows lie."""
    from tarnwork.llm import classifier

    rows = classifier.described(spark.createDataFrame([(i, f"text {i} " * (1 + i % 7)) for i in range(400)], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(i, int(i % 7 > 3)) for i in range(400)], "doc_id bigint, quality int")
    one, two = classifier.fit(rows, labels, 60), classifier.fit(rows.repartition(7), labels, 60)
    assert abs(one["beta"] - two["beta"]).max() < 1e-6 and (one["mean"] == two["mean"]).all()

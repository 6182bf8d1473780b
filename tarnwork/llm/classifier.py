"""Quality scores: ridge regression on random Fourier features of document statistics, then isotonic calibration.

Statistics are shares of byte classes, word and line counts and repeats, taken over the whole text; labels, language,
source and id are no inputs. ``cos(w x + b)`` features approximate a Gaussian kernel. Each partition of the labelled
sample sums its part of the normal equations; the sums are added and solved on the driver. Scores of rows kept out of
that fit are calibrated to shares of label 1 by pooling adjacent violators.

The fit uses at most ``FIT_ROWS`` labelled rows (those of smallest id hash), none with crc32(doc_id) mod 5 = 0; scoring
covers every row. Rows: a null text is empty and scored like one. Repeated rows are scored each; of repeated labels of
one doc_id the largest counts. Without labels every score is 0.5. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import _buffers, word_hashes
from .shared import staged
from .suffixes import _mix

FOLDS, FIT_ROWS = 5, 50_000
FEATURES, RIDGE, SEED = 256, 1.0, 8
_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "newline": b"\n", "blank": b" \t\r\x0b\x0c", "symbol": b"#*$%&|<>~^\\{}[]=+_@`",
    "stop": b".?;:,", "shout": b"!", "quote": b"'\"()-/", "high": bytes(range(128, 256)),
}
NAMES = (*_CLASSES, "other", "log_words", "word_bytes", "words_distinct", "top_word", "triples_distinct", "lines_distinct", "line_words", "log_bytes", "short_words")


def _per(of: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text, and how often its commonest comes."""
    order = np.lexsort((keys, of))
    o, k = of[order], keys[order]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (k[1:] != k[:-1])]) if len(o) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    count = np.diff([*first, len(o)])
    most = np.zeros(n)
    np.maximum.at(most, o[first], count)
    return np.bincount(o[first], minlength=n), most


def statistics(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of statistics (NAMES) for each text in buf."""
    n = len(ends)
    begin = np.concatenate([[0], ends[:-1]]) if n else ends
    size = (ends - begin).astype(float)
    some = np.maximum(size, 1)

    def share(table):
        sums = np.concatenate([[0], np.cumsum(table[buf], dtype=np.int64)])
        return (sums[ends] - sums[begin]) / some

    columns, rest = [], np.ones(256, bool)
    for members in _CLASSES.values():
        table = np.zeros(256, bool)
        table[list(members)] = True
        rest &= ~table
        columns.append(share(table))
    columns.append(share(rest))
    words, of = word_hashes(buf, ends)
    n_words = np.bincount(of, minlength=n)
    some_words = np.maximum(n_words, 1)
    spaces = columns[list(_CLASSES).index("newline")] + columns[list(_CLASSES).index("blank")]
    distinct, top = _per(of, words, n)
    full = of[2:] == of[:-2]
    triples, t_of = _mix(words[:-2] + words[1:-1] * np.uint64(3) + words[2:] * np.uint64(7))[full], of[:-2][full]
    n_triples, (d_triples, _) = np.bincount(t_of, minlength=n), _per(t_of, triples, n)
    # Lines, by the sum of their words' hashes: lines of the same words count as equal here.
    at_line = np.cumsum(buf == 10)
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
    word_at = _word_starts(buf, begin)
    line = at_line[word_at] if len(word_at) else np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (of[1:] != of[:-1])])) if len(of) else starts
    l_of, l_key = of[edge], np.add.reduceat(words, edge) if len(edge) else words
    n_lines, (d_lines, _) = np.bincount(l_of, minlength=n), _per(l_of, l_key, n)
    columns += [np.log1p(n_words), size * (1 - spaces) / some_words, distinct / some_words, top / some_words, d_triples / np.maximum(n_triples, 1), d_lines / np.maximum(n_lines, 1), n_words / np.maximum(n_lines, 1) / 50, np.log1p(size), (n_words < 20).astype(float)]
    return np.stack(columns, axis=1) if n else np.zeros((0, len(NAMES)))


def _word_starts(buf: np.ndarray, begin: np.ndarray) -> np.ndarray:
    from .ngrams import _SPACE

    inside = ~_SPACE[buf]
    before = np.concatenate([[False], inside[:-1]]) if len(buf) else inside
    before[begin[begin < len(buf)]] = False
    return np.flatnonzero(inside & ~before)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, x: statistics of every row."""

    def run(batches):
        for t, buf, ends in _buffers(batches, 1 << 20):
            x = statistics(buf, ends)
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays([t["doc_id"].cast(pa.int64()).combine_chunks(), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), flat)], ["doc_id", "x"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, x array<double>")
    return rows.withColumn("fold", fold(F.col("doc_id")))


def fold(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def fit(rows: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict | None:
    """The model, from labelled rows outside fold 0: fold 1 calibrates, the others fit."""
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    known = rows.filter("fold <> 0").join(marks, "doc_id")
    n = known.count()
    if n > fit_rows:  # by a threshold of the hash first, so that hardly more rows than asked for are sorted
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < -(-(1 << 20) * 5 * fit_rows // (4 * n)))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    known = staged(known.select("fold", "x", "y"), "classifier-rows").repartition(8)
    shape = known.agg(F.count("*").alias("n"), *(f(F.get("x", i)).alias(f"{k}{i}") for k, f in (("m", F.avg), ("s", F.stddev_pop)) for i in range(len(NAMES)))).first()
    if not shape["n"]:
        return None
    d = len(NAMES)
    mean, std = np.array([shape[f"m{i}"] for i in range(d)]), np.array([shape[f"s{i}"] or 0.0 for i in range(d)])
    rng = np.random.default_rng(SEED)
    model = {"mean": mean, "std": np.where(std > 1e-9, std, 1.0), "w": rng.normal(0, 1 / np.sqrt(2 * d), (d, FEATURES)), "b": rng.uniform(0, 2 * np.pi, FEATURES)}

    def sums(batches):
        a, c = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for t in batches:
            use = t["fold"].to_numpy() != 1
            z, y = lifted(model, _matrix(t["x"])[use]), t["y"].to_numpy()[use]
            a += z.T @ z
            c += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([c.tobytes()])], ["a", "c"])

    parts = known.mapInArrow(sums, "a binary, c binary").collect()  # one row for each of eight partitions
    a = sum(np.frombuffer(p["a"]).reshape(FEATURES + 1, -1) for p in parts)
    c = sum(np.frombuffer(p["c"]) for p in parts)
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-6
    model["beta"] = np.linalg.solve(a + penalty, c)

    def scored(batches):
        for t in batches:
            use = t["fold"].to_numpy() == 1
            yield pa.RecordBatch.from_arrays([pa.array(raw(model, _matrix(t["x"])[use])), pa.array(t["y"].to_numpy()[use])], ["s", "y"])

    held = known.mapInArrow(scored, "s double, y double").toPandas()
    model["at"], model["to"] = isotonic(held["s"].to_numpy(), held["y"].to_numpy())
    return model


def lifted(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["std"], -8, 8)
    return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ model["w"] + model["b"]), np.ones((len(x), 1))], axis=1)


def raw(model: dict, x: np.ndarray) -> np.ndarray:
    return lifted(model, x) @ model["beta"]


def isotonic(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and levels of the pooled blocks, levels rising."""
    if not len(s):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.lexsort((y, s))
    blocks: list[list[float]] = []  # sum of s, sum of y, rows
    for a, b in zip(s[order], y[order]):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def scores(rows: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, score of every row of described()."""
    if model is None:
        return rows.select("doc_id", (F.col("fold") == 0).alias("held_out"), F.lit(0.5).alias("score"))

    def run(batches):
        for t in batches:
            s = np.clip(np.interp(raw(model, _matrix(t["x"])), model["at"], model["to"]), 0, 1)
            yield pa.RecordBatch.from_arrays([t["doc_id"], pa.array(t["fold"].to_numpy() == 0), pa.array(s)], ["doc_id", "held_out", "score"])

    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = staged(described(docs), "classifier-statistics")
    return scores(rows, fit(rows, labels)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnwork.llm import quality

from . import brute

CLEAN = [f"{a}{b}{c}" for a in ("ho", "ta", "é", "su") for b in ("ri", "na", "lo") for c in ("", "s,", "n", "m.")]


def rows():
    rng = random.Random(6)
    vocab = ["the", "of", "and", "é", "x#y", "$$"] + [f"w{i}" for i in range(30)]
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "a b c a b c"), (4, "l 1\nl 1\n\nl 1 \nl 1"), (5, "a " * 60), (6, "a b\x0bc\x1cd"), (7, "# * $ % & | < > (")]
    for i in range(8, 60):
        out.append((i, " ".join(rng.choice(vocab) for _ in range(rng.choice([10, 49, 50, 51, 120]))).replace("w7", "w7\n")))
    return out + [(60, out[20][1]), (61, out[21][1]), (61, out[21][1]), (None, out[22][1])]


def test_base_facts_and_verdicts(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, 1) for r in data], "doc_id bigint, text string, llr int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8, 30)], "doc_id bigint, quality int, toxic int")
    got = quality.judge(docs, quality.ratios(docs, labels)).collect()
    facts = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got), key=str)
    assert facts == sorted(brute.quality([r for r in data if r[0] is not None]) + [(None, *brute.quality([(0, data[-1][1])])[0][1:])], key=str)
    for r in got:
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= quality.THRESHOLD)


def test_ratio_tells_junk_from_trusted(spark):
    rng = random.Random(1)
    text = lambda v: " ".join(rng.choice(v) for _ in range(200))
    good, bad = [f"g{i}" for i in range(80)], [f"b{i}" for i in range(80)]
    docs = spark.createDataFrame([(i, text(good if i % 2 else bad)) for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    got = quality.judge(docs, quality.ratios(docs, labels)).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == set(range(1, 60, 2))
    assert all(not r["llr"] for r in quality.judge(docs, quality.ratios(docs, labels.limit(0))).collect())
    assert quality.judge(docs.limit(0), quality.ratios(docs.limit(0), labels)).collect() == []


def test_every_trusted_document_counts(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('w', id) as text").unionAll(spark.createDataFrame([(None, "none"), (None, None)], "doc_id bigint, text string"))
    labels = spark.range(20_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    got = quality.ratios(docs.filter("doc_id is not null"), labels.unionAll(labels)).collect()
    assert got and all(abs(r["llr"]) < 1e-9 for r in got)
    less = [r["llr"] for r in quality.ratios(docs, labels).collect()]
    assert len(less) >= len(got) and min(less) < 0 and sum(x < 0 for x in less) == 1


@pytest.mark.parametrize("size", [40, 2000])
def test_rare_junk_is_told_in_small_and_large_tables(spark, size):
    rng = random.Random(2)
    clean = [(i, " ".join(rng.choice(CLEAN) for _ in range(100))) for i in range(size)]
    once = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiouäö" for c in "prstvxz"]
    junk = [(size, " ".join(f"{w}###" for w in once[:200])), (size + 1, " | ".join(once[200:300])), (size + 2, " ".join(f"{w.upper()}!!" for w in once[:60]))]
    docs = spark.createDataFrame(clean + junk, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, size, 2)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, quality.ratios(docs, labels)).collect()}
    assert got == {i: i < size for i in range(size + 3)}


DATA = "/root/testdata"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_one_threshold_parts_the_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"{DATA}/{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = quality.judge(docs, quality.ratios(docs, labels)).filter("not base_failed").join(labels, "doc_id").collect()
    assert {r["quality"] for r in got} == {0, 1} and all(r["kept"] == (r["quality"] == 1) for r in got)


def test_pairs_of_words_count(spark):
    rng = random.Random(3)
    vocab = [f"{a}{b}" for a in "bdfg" for b in "aeiou"]
    after = {w: v for w, v in zip(vocab, vocab[1:] + vocab[:1])}

    def text(ordered):
        pairs = [(w, after[w]) for w in vocab] * 5
        rng.shuffle(pairs)
        words = [w for p in pairs for w in p]
        return " ".join(words if ordered else rng.sample(words, len(words)))

    docs = spark.createDataFrame([(i, text(i % 2)) for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 60, 4)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["llr"] for r in quality.judge(docs, quality.ratios(docs, labels)).collect()}
    assert min(x for i, x in got.items() if i % 2) > max(x for i, x in got.items() if not i % 2)


def plain_ratios(rows, trusted, sizes=(1, 2)):
    """llr of each text: both multinomials over hashed n-grams, counted, smoothed and averaged in plain Python."""
    low = quality.CLASSES - 1

    def word_class(w):
        shape = re.sub("[0-9]+", "0", re.sub(r"[a-z\x80-\U0010ffff]+", "a", re.sub("[A-Z]+", "A", w)))
        return 0 if re.fullmatch("[aA]+[.,]?", shape) else 1 + brute.spark_hash(shape) % low

    marked = lambda h, c: (h & ~low) | c

    def grams(text):
        words = [marked(brute.spark_hash(w), word_class(w)) for w in brute.SPACE_WORD.findall(text or "")]
        for k in sizes:
            for i in range(len(words) - k + 1):
                some = words[i : i + k]
                classes = [w & low for w in some]
                yield some[0] if k == 1 else marked(brute.spark_hash(*some), 0 if not any(classes) else 1 + brute.spark_hash(*classes) % low)

    half = quality.BUCKETS // 2
    each = half // quality.CLASSES
    bucket = lambda h: (h >> 7) % half if not h & low else half + (h & low) * each + (h >> 7) % each
    raw, target = Counter(), Counter()
    for d, t in rows:
        raw.update(map(bucket, grams(t)))
        if d in trusted:
            target.update(map(bucket, grams(t)))
    share = sum(target.values()) / sum(raw.values())
    of = lambda b: 0 if b < half else (b - half) // each
    rho = {c: (sum(target[b] for b in raw if of(b) == c) + quality.SMOOTHING) / (share * sum(raw[b] for b in raw if of(b) == c) + quality.SMOOTHING) for c in {of(b) for b in raw}}
    llr = {b: math.log((target[b] + quality.SMOOTHING * rho[of(b)]) / (raw[b] * share + quality.SMOOTHING)) for b in raw}
    out = []
    for _, t in rows:
        g = [llr[bucket(h)] for h in grams(t)]
        out.append(sum(g) / len(g) if g else 0.0)
    return out


def test_ratios_against_plain_multinomials(spark):
    rng = random.Random(8)
    vocab = CLEAN + ["x#y", "$$", "ABC", "12.5", "don't", "É", "|", "ẃ"]
    rows_ = [(i, " ".join(rng.choice(vocab if i % 3 else CLEAN) for _ in range(rng.choice([0, 1, 2, 60, 150])))) for i in range(120)] + [(None, "no id, no trust"), (5, None)]
    trusted = set(range(0, 120, 3))
    docs = spark.createDataFrame(rows_, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, None if i % 2 else 0) for i in trusted] + [(1, 1, 1), (2, 0, 0), (None, 1, 0), (0, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {(r["doc_id"], r["text_hash"]): (r["llr"], r["kept"], r["base_failed"]) for r in quality.judge(docs, quality.ratios(docs, labels)).collect()}
    shuffled = {r["bucket"]: r["llr"] for r in quality.ratios(docs, labels, most=3).collect()}
    assert shuffled == pytest.approx({r["bucket"]: r["llr"] for r in quality.ratios(docs, labels).collect()})
    for (d, t), want in zip(rows_, plain_ratios(rows_, trusted)):
        llr, kept, failed = got[d, brute.spark_hash(t or "")]
        assert llr == pytest.approx(want, abs=2e-9) and kept == (not failed and llr >= quality.THRESHOLD)


def test_very_long_text_and_shared_high_bits(spark):
    n = quality.PLACE + 200
    words = [f"w{i}" for i in range(n)]
    words[n - 9 : n - 4] = words[:5]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "a b c d a b c x")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_repeat_words"]) for r in quality.judge(docs, spark.createDataFrame([], "bucket int, llr double")).collect()}
    assert got == {1: (n, 10), 2: (8, 6)}
    # Windows A, B, A by place, where A and B share their high bits: sorted by place they are no neighbours.
    a, b = (7 << 20) | 1, (7 << 20) | 2
    df = spark.createDataFrame([([a, b, a, 5 << 20],), ([5 << 20, a, 9 << 20, a],), ([b, a],)], "h array<bigint>")
    h = F.col("h")
    df = df.withColumn("s", quality._by_place(h)).withColumn("f", quality._follows(h, F.col("s"))).withColumn("p", quality._pairs(h))
    got = df.select(quality._hits(F.col("s"), F.col("f")), quality._hits_of_pairs(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(None, [0, 2]), ([1, 3], [1, 3]), (None, [])]


def test_clashing_names_and_empty_labels(spark):
    docs = spark.createDataFrame([(1, "a b c " * 30, 1, "x", 2)] * 2, "doc_id bigint, text string, _copies int, bucket string, _h int")
    got = quality.judge(docs, quality.ratios(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))).collect()
    assert len(got) == 2 and {r["llr"] for r in got} == {0.0}

"""The pipeline's stages on a small corpus, each held against plain Python or an invariant."""

import random
from array import array

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tarnwork.llm import mixing, shared
from tarnwork.llm.queries import token_file

from . import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    words = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))
    shared = "a passage of quite a few words that many of these documents hold word for word, again and again. "
    rows = []
    for i in range(120):
        t = words(rng.randint(60, 160))
        if i % 4 == 0:
            t = shared + t
        if i % 10 == 3:
            t = rows[-1][1]
        if i % 10 == 5:
            w = rows[-1][1].split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        if i % 12 == 7:
            t = " ".join(f"J{rng.randrange(9)}###" for _ in range(120))
        rows.append((i, t, "en", f"s{i % 3}" if i % 7 else None, len(t)))
    rows += [(200, None, "en", "s0", 0), (201, "", "en", "s1", 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 12 != 7), 0) for i in range(0, 120, 2)] + [(7, 0, 0), (19, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


VOCAB = [f"word{i}" for i in range(400)]


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "mixing sources to target weights", "packing"]
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        held = docs.collect()
        docs = spark.createDataFrame(held, docs.schema)
        out.append(held)
        if len(out) < 5:
            assert docs.columns == columns
    kept = {r["doc_id"] for r in out[0]}
    failed = {d for d, *_, bad in brute.quality([r[:2] for r in rows]) if bad}
    assert kept == {r[0] for r in rows} - failed - {i for i in range(120) if i % 12 == 7}
    sets = {}
    for r in out[0]:
        w = r["text"].lower().split(" ")
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    alone = set()
    for d in sorted(sets):
        if not any(5 * len(sets[d] & sets[x]) >= 4 * len(sets[d] | sets[x]) for x in sets if x < d):
            alone.add(d)
    assert {r["doc_id"] for r in out[1]} == alone and len(alone) < len(kept)
    want = brute.suffixes([(r["doc_id"], r["text"]) for r in out[1]])
    assert sorted((r["doc_id"], len(r["text"].encode())) for r in out[2]) == [(d, n - gone) for d, n, gone, *_ in want]
    assert any(gone for _, _, gone, *_ in want) and all(len(r["text"]) == r["n_chars"] for r in out[2])
    size = lambda held: sum(len((r["text"] or "").split()) for r in held)
    assert abs(size(out[3]) - 1.5 * size(out[2])) <= 4
    t = Tokenizer.from_file(token_file())
    tokens = sum(len(array("I", t.encode(r["text"] or "", add_special_tokens=False).ids)) + 1 for r in out[3])
    assert sum(r["length"] for r in out[4]) == tokens and all(r["offset"] + r["length"] <= 4096 for r in out[4])


def test_run_and_empty(spark, folder, tmp_path):
    path, _ = folder
    assert corpus_pipeline.run(spark, path).count() > 0
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CLASHING = ["text_hash", "copy", "_start", "_nth", "_batch", "_key", "_id", "_hash", "_slot", "epoch", "label", "none", "_once", "a.b"]


def test_stages_keep_any_columns(spark, folder):
    """Names that the stages use themselves come back as they were, in their rows."""
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in CLASHING})
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, docs, path)
        assert held.columns == columns
        held = held.collect()
        assert held and all(r[c] == f"{c}:{r['doc_id']}" for r in held for c in CLASHING)
        docs = spark.createDataFrame(held, docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() > 0


def test_one_row_of_each_group_whatever_its_ids(spark, folder, tmp_path):
    """Near copies under one id, without ids, and rows alike in both: one stays; rows without words stay all."""
    rng = random.Random(4)
    w = [rng.choice(VOCAB) for _ in range(80)]
    near = lambda i: " ".join(w[:i] + ["odd"] + w[i + 1 :])
    other = [" ".join(rng.choice(VOCAB) for _ in range(60)) for _ in range(2)]
    rows = [(1, near(2)), (1, near(77)), (1, near(2)), (None, other[0]), (None, other[0] + " end"), (None, other[0]), (5, other[1]), (None, other[1]), (7, None), (7, None), (8, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.ngram_jaccard_join(spark, docs, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "5", "7", "7", "8", "None"]
    assert {r["text"] for r in got if r["doc_id"] is None} < {other[0], other[0] + " end"}


def test_mixing_writes_rows_in_the_order_of_slots(spark, tmp_path):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(VOCAB) for _ in range(rng.randint(5, 400))), "en", "abc"[i % 3], 0) for i in range(400)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    first = {r["doc_id"]: r["first_slot"] for r in mixing.taken(docs).collect()}
    got = corpus_pipeline.mixing_to_weights(spark, docs, str(tmp_path)).collect()
    seen, order = set(), []
    for r in got:
        if r["doc_id"] not in seen:
            seen.add(r["doc_id"])
            order.append(first[r["doc_id"]])
    assert len(order) > 300 and order == sorted(order)


def test_staged_tables_go(spark, folder):
    before = shared.opened()
    path, _ = folder
    corpus_pipeline.run(spark, path).count()
    assert len(shared.opened() - before) <= 2  # the last stage's input and its own table

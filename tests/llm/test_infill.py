import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwork.llm import infill

from . import brute


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abYZ é<>P\n0😀", max_size=80), st.integers(1, 7))
def test_checkpoints_find_every_cut(text, step):
    units = brute.UNIT.findall(text)
    index = infill.Index(text.encode(), step)
    assert (index.n, index.n_points) == (len(units), len(text))
    for cut in range(len(units) + 1):
        before = "".join(units[:cut])
        assert index.offsets(cut) == (len(before.encode()), len(before))


def test_texts_longer_than_chunks_and_scans():
    """A run of letters beyond one scan and one counted chunk, code points over chunks' ends."""
    rng = random.Random(5)
    text = "é" + "a" * (infill.CHUNK + infill.SCAN) + "".join(rng.choice("ab é😀.") for _ in range(300_000)) + "z" * 9000 + "!"
    units = brute.UNIT.findall(text)
    index = infill.Index(text.encode())
    for cut in [0, 1, 2, 3, len(units) - 1, len(units), *(rng.randrange(len(units)) for _ in range(40))]:
        before = "".join(units[:cut])
        assert index.offsets(cut) == (len(before.encode()), len(before))
    assert len(index.units) == -(-len(units) // infill.STEP) == len(index.bytes) == len(index.points)


def rows(spark, data, schema="doc_id bigint, text string", **kw):
    df = infill.fill(spark.createDataFrame(data, schema), **kw)
    return df.withColumn("back", infill.restored(F.col("output"), F.col("form"), kw.get("sentinels", infill.SENTINELS))).collect()


def test_against_plain(spark):
    rng = random.Random(2)
    data = [(i, "".join(rng.choice(["word", "é", " ", "\n", "<", "<S", "S>", "😀", "x1"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    data += [(900, None), (901, ""), (902, "with <M> inside"), (None, "no id at all, cut like an empty one"), (903, "w" * 10_000), (903, "w" * 10_000), (904, "é" * 700_000), (-5, "minus five is an id")]
    got = rows(spark, data)
    assert sorted((r[:6] for r in map(tuple, got)), key=str) == sorted(((d, *brute.infill(d, t)) for d, t in data), key=str)
    assert sorted((str(r["doc_id"]), r["back"]) for r in got) == sorted((str(d), t or "") for d, t in data)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_other_sentinels_and_shares(spark):
    data = [(i, f"text {i} with <P> and [P] signs"[: 20 + i]) for i in range(40)]
    for spm, form in ((100, "spm"), (0, "psm")):
        got = rows(spark, data, sentinels=("[A]", "[B]", "[C]"), plain=0, spm=spm)
        assert {r["form"] for r in got} == {form} and sorted(r["back"] for r in got) == sorted(t for _, t in data)


def test_empty_table_and_clashing_names(spark):
    assert rows(spark, []) == []
    got = rows(spark, [(1, "some text here", "x", 2)], "doc_id int, text string, output string, n int")
    assert [r["back"] for r in got] == ["some text here"] and got[0].__fields__[:3] == ["doc_id", "n", "form"]

import zlib
from array import array

import pytest
from tokenizers import Tokenizer

from tarnwork.llm import packing
from tarnwork.llm.queries import token_file

TEXTS = ["", None, "Hello  world\n\tit's 'll <|endoftext|> x", "é É é ́a İ ΑΣ ß", "a\x1cb\x85c d", "word " * 9000, "word " * 9000, "x" * 5000]


def test_ids_are_those_of_whole_texts():
    t = Tokenizer.from_file(token_file())
    want = [array("I", t.encode(x or "", add_special_tokens=False).ids).tobytes() for x in TEXTS]
    assert packing.encode(TEXTS, token_file()) == want


def test_ids_of_all_kinds_of_characters():
    t = Tokenizer.from_file(token_file())
    rng = __import__("random").Random(1)
    common = [chr(c) for c in range(0x250) if chr(c) not in "<>"]
    rare = common + list("\u0301\u0345\u2028\u3000\uac00\u1100\u1161ΣςİK\U0001f600१")
    texts = ["".join(rng.choice(common if i % 2 else rare) for _ in range(60)) for i in range(400)]
    texts += [" ".join("".join(rng.choice("ab's'llé1²½!#$ªº") for _ in range(5)) for _ in range(9)) for _ in range(200)]
    assert packing.encode(texts, token_file()) == [array("I", t.encode(x, add_special_tokens=False).ids).tobytes() for x in texts]


def test_apostrophes_and_a_full_store(monkeypatch):
    t = Tokenizer.from_file(token_file())
    rng = __import__("random").Random(3)
    texts = ["".join(rng.choice(["'", "'", "s", "t", "re", "ve", "ll", "m", "d", "!", " ", "\n", "1", "\xa0", "é", "x"]) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    texts += ["'", "a'", "'s", "it's", "'re'll", "''s", "'1", "x" * 30 + "'ve"]
    want = [array("I", t.encode(x, add_special_tokens=False).ids).tobytes() for x in texts]
    monkeypatch.setattr(packing, "CACHED", 50)  # too small for all pieces: the others are made again
    monkeypatch.setattr(packing, "_tokenizers", {})
    for at in range(0, len(texts), 100):
        assert packing.encode(texts[at : at + 100], token_file()) == want[at : at + 100]


def test_every_id_once_and_no_gaps(spark):
    df = spark.createDataFrame([(i if i != 6 else 5, x, 1) for i, x in enumerate(TEXTS)], "doc_id bigint, text string, length int")
    rows = packing.pack_documents(df, token_file(), with_ids=True).collect()
    t = Tokenizer.from_file(token_file())
    docs, windows = {}, {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        docs.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    for i, x in enumerate(TEXTS):
        if i in (5, 6):
            continue
        assert b"".join(r["ids"] for r in sorted(docs[i], key=lambda r: r["start"])) == array("I", t.encode(x or "", add_special_tokens=False).ids + [2]).tobytes()
    assert sum(r["length"] for r in docs[5]) == 2 * docs[5][0]["doc_tokens"]
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert packing.pack_documents(df.limit(0), token_file()).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_rule_matches_a_plain_one(seed):
    import random

    rng = random.Random(seed)
    length, sizes = 50, [rng.randint(1, 50) for _ in range(300)]
    levels, want = {}, []
    for s in sizes:
        options = []
        for h in [0, *sorted(h for h, n in levels.items() if n and h + s <= length)]:
            after = dict(levels)
            if h:
                after[h] -= 1
            if h + s < length:
                after[h + s] = after.get(h + s, 0) + 1
            options.append((sum(n * n for n in after.values()), -h, after))
        _, h, levels = min(options, key=lambda x: x[:2])
        want.append(-h)
    window, place = packing.sum_of_squares(sizes, length)
    assert place.tolist() == want
    fill = {}
    for w, p, s in zip(window, place, sizes):
        assert fill.get(w, 0) == p
        fill[w] = p + s

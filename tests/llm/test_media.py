import hashlib
import random
import zlib

import pytest

from tarnwork.llm import media


def test_items_stay_in_order_with_captions():
    page = "<title>T</title><p>one <b>two</b><img src=a alt='A'>three<figure><img src=b><img src=c alt=x><figcaption>both &amp; all</figcaption></figure><script>no()</script><p>four"
    assert [(x["position"], x["kind"], x["text"] or x["ref"], x["caption"]) for x in media.parse(page)] == [
        (0, "text", "T", None), (1, "text", "one two", None), (2, "media", "a", "A"), (3, "text", "three", None), (4, "media", "b", "both & all"), (5, "media", "c", "both & all"), (6, "text", "four", None),
    ]
    assert media.parse(None) == [] == media.parse("")


def test_damage_is_seen():
    png = media.to_png(bytes(range(192)) * 3)
    assert media.from_png(png) == bytes(range(192)) * 3
    for bad in (png[:-20] + b"x" + png[-19:], b"no", png[:40] + b"\0" + png[41:]):
        with pytest.raises(Exception):
            media.from_png(bad)


def plain_feature(payload):
    """Mean, shares of eight ranges of values in thousandths, and which of 8 x 8 blocks are above the mean."""
    wide, rows = 192, len(payload) // 192
    mean = sum(payload) / len(payload)
    shares = [sum(x >> 5 == k for x in payload) * 1000 // len(payload) for k in range(8)]
    bits = ""
    for i in range(8):
        low, high = i * rows // 8, max((i + 1) * rows // 8, i * rows // 8 + 1)
        for j in range(8):
            block = [payload[y * wide + x] for y in range(low, high) for x in range(j * 24, j * 24 + 24)]
            bits += "01"[sum(block) / len(block) > mean]
    return f"{mean:.3f}:{','.join(map(str, shares))}:{int(bits, 2):016x}"


def test_long_texts_close_their_page(spark):
    df = spark.createDataFrame([(1, "x" * (5 << 20)), (2, "y"), (3, "z" * 200)], "doc_id bigint, text string").coalesce(1)
    got = {r["doc_id"]: r for r in media.text_media(df).collect()}
    assert got[1]["page"] != got[2]["page"] == got[3]["page"] and got[1]["payload_bytes"] % 192 == 0 and got[1]["n_bytes"] == 5 << 20


def test_text_media(spark):
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, "a" * 192), (4, "é" * 96), (5, "a" * 193), (6, "a" * 193), (7, "".join(rng.choice("ab\nü€") for _ in range(5000))), (7, "twice"), (7, "twice"), (None, "n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, digest string")
    got = media.text_media(df).collect()
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        pay = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        png = media.to_png(pay)
        want.append((d, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]), len(png), hashlib.sha256(png).hexdigest(), f"Document {d}: {len(raw)} bytes of text", plain_feature(pay)))
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "caption", "feature")
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(want, key=str)
    # Figures of one page: a title first, then a heading, a paragraph and a figure for each document.
    by_page = {}
    for r in got:
        by_page.setdefault(r["page"], []).append(r["position"])
    assert all(sorted(p) == [3 + 3 * i for i in range(len(p))] for p in by_page.values()) and max(map(len, by_page.values())) > 1
    assert media.text_media(df.limit(0)).collect() == []


def test_unknown_references_stay(spark):
    pages = spark.createDataFrame([(1, "<img src='http://x/y.png' alt=z>"), (2, None)], "page_id bigint, html string")
    facts = spark.createDataFrame([], media.FACTS)
    assert [(r["page_id"], r["position"], r["caption"], r["payload_bytes"]) for r in media.resolve(media.sequences(pages, "page_id"), facts).collect()] == [(1, 0, "z", None)]

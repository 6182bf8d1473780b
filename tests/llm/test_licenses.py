import random

from tarnwork.llm import licenses

from . import brute

ROWS = [
    (1, "Released under the MIT License."), (2, "released UNDER the mit-license\nand cc\tby CC BY cc"), (3, None), (4, ""), (5, "All rights  reserved; all rights reserved"),
    (6, "Permission is hereby granted, free of charge, to any other person obtaining a copy of this software and its associated documentation files"),
    (7, "This work is licensed under the GNU General Public License, version 3."), (8, "é cc by é"), (9, "under the released mit license"), (10, "cc"),
    (11, "x " * 3000 + "Licensed under the Apache License, Version 2.0. " * 3), (12, "ccby rights reserved"), (13, "cc by"), (13, "cc by"),
]


def test_scan(spark):
    df = spark.createDataFrame([(*r, "z", 1) for r in ROWS], "doc_id bigint, text string, labels string, t int")
    got = {(r["doc_id"]): r for r in licenses.scan(df).collect()}
    rows = licenses.scan(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, rows), key=str) == brute.licenses(ROWS)
    labels = {d: r["labels"] for d, r in got.items()}
    assert labels == {1: "mit", 2: "cc-by,mit", 3: "", 4: "", 5: "reserved", 6: "mit", 7: "gpl,gpl-3.0", 8: "cc-by", 9: "", 10: "", 11: "apache-2.0", 12: "", 13: "cc-by"}
    assert [(s["start"], s["end"]) for s in got[11]["spans"]] == [(3000 + 8 * i, 3008 + 8 * i) for i in range(3)]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1]["score"] == 1 and got[9]["score"] == 0
    assert got[6]["score"] == 1  # two words put in: three neighbouring diagonals, which cover every word together
    [span] = got[6]["spans"]
    assert (span["start"], span["end"]) == (0, 22)


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def plain_labels(text, k=3, slack=3, cover=0.8):
    """Labels, plainly: on each diagonal, the longest run in order of the words that stand in common grams near it."""
    words = [w.decode() for w in brute.LICENSE_WORD.findall(brute.lowered(text).encode())]
    out = {}
    for label, phrase in licenses.TEMPLATES:
        p = phrase.split()
        at = {}
        for i in range(len(words) - k + 1):
            for j in range(len(p) - k + 1):
                if words[i : i + k] == p[j : j + k]:
                    at.setdefault(i - j, set()).update(range(j, j + k))
        for d in at:
            some = {(o, j) for o in range(-slack, slack + 1) for j in at.get(d + o, ())}
            if len({j for _, j in some}) < cover * len(p):
                continue
            known = {(j, -slack - 1): 0 for j in range(-1, len(p))}
            for j in range(-1, len(p)):
                for o in range(-slack, slack + 1):
                    known[j, o] = max(known.get((j - 1, o), 0) + ((o, j) in some) if j >= 0 else 0, known.get((j - 1, o + 1), 0), known.get((j, o - 1), 0))
            share = known[len(p) - 1, slack] / len(p)
            if share >= cover:
                out[label] = max(out.get(label, 0), share)
    return out


def test_labels_against_a_plain_version(spark):
    rng = random.Random(4)
    phrases = [p.split() for _, p in licenses.TEMPLATES]
    rows = [(1000, "licensed under the " * 4 + "apache license version 2 0"), (1001, "released under the mit " * 50 + "license"), (1002, "licensed under the gnu general public license " * 30 + "version 3")]
    for i in range(150):
        words = []
        for _ in range(rng.randint(1, 3)):
            p = list(rng.choice(phrases))
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(p))
                p[at : at + rng.randint(0, 1)] = rng.choice([[], ["odd"], [p[at]], p[max(0, at - 2) : at + 1]])
            words += ["filler"] * rng.randint(0, 3) + p + p[: rng.choice([0, 0, 3, 5])]
        rows.append((i, " ".join(words)))
    rows.append((2000, " ".join(f"w{i % 997}" for i in range(120_000)) + " released under the mit license " + "under the mit " * 3000))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert got[1000]["labels"] == "apache-2.0" and got[1000]["score"] == 1
    for d, text in rows:
        want = plain_labels(text)
        have = {s["label"]: s["covered"] for s in sorted(got[d]["spans"], key=lambda s: s["covered"])}
        assert have == want, (d, text[:200])


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, "released under the mit license", 5, "x")] * 3 + [(None, None, 6, "y")] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, t int, _key string")
    got = licenses.scan(df).collect()
    assert sorted((r["doc_id"] is None, r["labels"], len(r["spans"])) for r in got) == [(False, "mit", 1)] * 3 + [(True, "", 0)] * 2

"""Plain Python versions of the contracts, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash

LICENSE_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def suffixes(rows, span=50):
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - span + 1):
            w = b[i : i + span]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] < d:
                gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def licenses(rows):
    base = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    out = []
    for d, t in rows:
        words = [w.decode() for w in LICENSE_WORD.findall(lowered(t).encode())]
        at, labels = [], set()
        for phrase, label in base.items():
            p = phrase.split()
            hits = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            at += hits
            if hits:
                labels.add(label)
        out.append((d, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    return sorted(out, key=str)


def quality(rows):
    out = []
    for d, t in rows:
        t = t or ""
        words = SPACE_WORD.findall(t)
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if SPACE_WORD.search(x)]
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        out.append((d, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed))
    return sorted(out)


def jaccard(rows):
    sets = {}
    for d, t in rows:
        w = SPACE_WORD.findall(lowered(t))
        sets[d] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 10 * min(len(x), len(y)) >= 9 * max(len(x), len(y)) and 100 * len(x & y) >= 90 * len(x | y):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return sorted((d, len(sets[d]), root(d)) for d in ids)


def spark_hash(*values, seed=42):
    """xxhash64 of Spark, signed: of texts, of longs, and of (value, width) for numbers of other widths; null changes nothing."""
    h = seed
    for v in values:
        if v is None:
            continue
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        h = xxhash.xxh64_intdigest(raw, seed=h % (1 << 64))
    return h - (1 << 64) if h >= 1 << 63 else h


def itemsets(rows, least=5, share=20_000):
    """items: (support, {c: (a, s)}) of each closed itemset of (basket, item) rows, with its rules at 60 of 100."""
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    sets, n = [frozenset(x) for x in baskets.values()], len(baskets)
    least = max(least, -(-n // share))
    support = lambda x: sum(x <= b for b in sets)
    found, now = {}, {frozenset([i]) for b in sets for i in b}
    while now:
        now = {x: s for x in now if (s := support(x)) >= least}
        found |= now
        single = [i for i in {i for x in now for i in x}]
        now = {x | {i} for x in now for i in single if i not in x}
    out = {}
    for x, s in found.items():
        if any(found.get(x | {i}) == s for i in {i for y in found for i in y} - x):
            continue
        rules = {}
        for c in x if len(x) > 1 else ():
            a, one = found[x - {c}], found[frozenset([c])]
            if 100 * s >= 60 * a and s * n > a * one:
                rules[c] = (a, one)
        out[tuple(sorted(x))] = (s, rules)
    return out


UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def infill(doc, text, plain=10, spm=20):
    """n, form, prefix_chars, middle_chars, output of a text."""
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 100 - plain:
        return len(units), "plain", None, None, text
    x, y, z = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm:
        return len(units), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return len(units), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"

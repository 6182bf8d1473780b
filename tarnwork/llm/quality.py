"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus, in DataFrame functions.

Two multinomials over hashed word n-grams (single words and pairs): the raw one counts every gram of every document,
the target one those of trusted documents. Rare grams are taken by the shapes of their words. A text's verdict is the
mean log ratio of its grams against a fixed threshold, so the same text always gets the same verdict (no draws).

Rows: a null text has no words. Repeated rows are judged each. Texts under the word minimum fail the base rules. A text
whose ratio is the threshold is kept. Texts of any length are read whole, and counts are exact in all. Labels without an
id mark nothing, and repeated ones once. Other columns are not looked at, whatever their names. An empty table gives no
rows. Without trusted documents every ratio is 0, and the base rules alone decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import each_copy, staged, words_of

#: Hash buckets: the bound of both multinomials and of the table that scoring broadcasts.
BUCKETS = 1 << 18
#: Texts whose mean log ratio is below this are rejected.
THRESHOLD = -0.25
#: Prior count of each bucket in the target, and of each class of word shapes.
SMOOTHING = 5.0
#: Classes of word shapes, a power of 2. Class 0, plain words, has half of the buckets; the others share the other half.
CLASSES = 128
#: Trusted ids that are broadcast, at most (16 MB of longs).
MOST = 1 << 20
#: Low bits of a long that hold a window's place in texts of up to so many windows.
PLACE = (1 << 20) - 1


def _marked(h, cls):
    """A hash whose low bits are replaced by a class."""
    return h.bitwiseAND(F.lit(~(CLASSES - 1))).bitwiseOR(cls.cast("long"))


def _class(h):
    return h.bitwiseAND(F.lit(CLASSES - 1))


def _word_class(w):
    """0 for letters with at most a full stop or comma behind them, else the hash of the shape: runs of capitals, other
    letters (all of non-ASCII among them) and digits become one character each, the rest stays."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "[A-Z]+", "A"), r"[a-z\x{80}-\x{10FFFF}]+", "a"), "[0-9]+", "0")
    return F.when(w.rlike(r"^[A-Za-z\x{80}-\x{10FFFF}]++[.,]?$"), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(shape), F.lit(CLASSES - 1)))


def _marked_words(words):
    """Hash of each word, marked with its class."""
    return F.transform(words, lambda w: _marked(F.xxhash64(w), _word_class(w)))


def _neighbours(marked):
    """a, b: each marked word and the next one, null after the last."""
    return F.arrays_zip(marked.alias("a"), F.slice(marked, F.lit(2), F.greatest(F.size(marked), F.lit(1))).alias("b"))


def _marked_pair(a, b):
    """Hash of two marked words, marked with the pair's class: 0 if both are plain, else by theirs."""
    both = 1 + F.pmod(F.xxhash64(_class(a), _class(b)), F.lit(CLASSES - 1))
    return _marked(F.xxhash64(a, b), F.when(_class(a.bitwiseOR(b)) == 0, F.lit(0)).otherwise(both))


def _buckets(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, one, two: buckets of the gram of one word and of the pair that starts at each of rows' _z; null without one.

    Row by row after the arrays are exploded, where Spark compiles what it would interpret within a lambda.
    """
    a, b = F.col("_z.a"), F.col("_z.b")
    return rows.select(*keep, _bucket(a).alias("one"), F.when(b.isNotNull(), _bucket(_marked_pair(a, b))).alias("two"))


def _bucket(h):
    """Bucket of a marked hash; its class can be told from it."""
    half, each = BUCKETS // 2, BUCKETS // 2 // CLASSES
    rest = F.shiftright(h, CLASSES.bit_length() - 1)
    return F.when(_class(h) == 0, F.pmod(rest, F.lit(half))).otherwise(half + _class(h) * each + F.pmod(rest, F.lit(each))).cast("int")


def _bucket_class(bucket):
    half = BUCKETS // 2
    return F.when(bucket < half, F.lit(0)).otherwise(F.floor((bucket - half) / (half // CLASSES))).cast("int")


def ratios(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """bucket, llr: at most BUCKETS rows. All documents count, and all trusted ones count for the target.

    Trusted ids are broadcast while they are counted to be most at most; beyond that, documents meet them by shuffle.
    """
    trusted = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    text = F.coalesce("text", F.lit(""))
    if trusted.limit(most + 1).count() <= most:
        rows = docs.select("doc_id", text.alias("_text")).join(F.broadcast(trusted.withColumn("_t", F.lit(1))), "doc_id", "left")
    else:
        # Rows without id, which are never trusted, are dealt by text.
        trusted = trusted.select("doc_id", F.lit(0).cast("long").alias("_salt"), F.lit(1).alias("_t"))
        salted = docs.select("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)).alias("_salt"), text.alias("_text"))
        rows = salted.join(trusted, ["doc_id", "_salt"], "left")
    each = rows.select(F.coalesce("_t", F.lit(0)).alias("_t"), _marked_words(words_of(F.col("_text"))).alias("_m"))
    grams = _buckets(each.select("_t", F.explode_outer(_neighbours(F.col("_m"))).alias("_z")), "_t")
    counts = grams.select("_t", F.explode(F.array("one", "two")).alias("bucket")).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_t").alias("target"))
    counts = staged(counts, "quality-counts")
    total = counts.agg(F.sum("raw").alias("r"), F.sum("target").alias("t")).first()
    r, t = float(total["r"] or 0), float(total["t"] or 0)
    if not t:
        return counts.select("bucket", F.lit(0.0).alias("llr"))
    # The prior of a bucket is SMOOTHING target counts, parted as its class is: rare grams get the ratio of their class,
    # however large the corpus, and frequent ones their own.
    parted = counts.withColumn("class", _bucket_class(F.col("bucket")))
    rho = (F.sum("target") + SMOOTHING) / (F.sum("raw") * (t / r) + SMOOTHING)
    known = parted.join(F.broadcast(parted.groupBy("class").agg(rho.alias("_rho"))), "class")
    return known.select("bucket", F.log((F.col("target") + SMOOTHING * F.col("_rho")) / (F.col("raw") * (t / r) + SMOOTHING)).alias("llr"))


def facts(words, text):
    """Base facts of a text, from its words array and its text."""
    n = F.size(words)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def _same(x, y):
    return F.coalesce(x == y, F.lit(False))


def _by_place(hashes):
    """Hash and place of each window in one long, sorted: a primitive sort puts windows of equal high bits side by side."""
    return F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long"))))


def _follows(hashes, s):
    """Of windows sorted by place in the same long, whether the next is equal (1), or in its high bits alone (2)."""
    full = lambda x: F.get(hashes, x.bitwiseAND(F.lit(PLACE)).cast("int"))
    high = lambda x: F.shiftright(x, 20)
    return F.transform(s, lambda x, i: F.when(_same(high(x), high(F.get(s, i + 1))), F.when(full(x) == full(F.get(s, i + 1)), 1).otherwise(2)).otherwise(0))


def _hits(s, follows):
    """Places, in order, of the windows that come twice or more; null if unequal windows share high bits, which takes
    sorting by whole hashes."""
    found = F.transform(s, lambda x, i: F.when((F.get(follows, i) == 1) | _same(F.get(follows, i - 1), F.lit(1)), x.bitwiseAND(F.lit(PLACE))))
    return F.when(~F.array_contains(follows, 2), F.array_sort(F.array_compact(found)))


def _pairs(hashes):
    """Hash and place of each window, sorted, for texts of any length."""
    return F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))


def _hits_of_pairs(s):
    found = F.transform(s, lambda x, i: F.when(_same(x["h"], F.get(s, i + 1)["h"]) | _same(x["h"], F.get(s, i - 1)["h"]), x["i"]))
    return F.array_sort(F.array_compact(found))


def judge(docs: DataFrame, llr: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr, and text_hash.

    text_hash (of the text) tells apart rows that share a doc_id.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_w", words_of(F.col("_text")))
    n = F.size("_w")
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    base = base.withColumn("_m", _marked_words(F.col("_w"))).withColumn("_h3", F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    some = F.size("_h3") > F.size(F.array_distinct("_h3"))
    none = F.array().cast("array<bigint>")
    # Step by step: what a lambda looks up must be a column, or it would be made again for each element.
    base = base.withColumn("_sorted", F.when(some & (F.size("_h3") <= PLACE + 1), _by_place(F.col("_h3"))).when(~some, none))
    base = base.withColumn("_next", _follows(F.col("_h3"), F.col("_sorted")))
    base = base.withColumn("_quick", _hits(F.col("_sorted"), F.col("_next")))
    base = base.withColumn("_pairs", F.when(F.col("_quick").isNull(), _pairs(F.col("_h3"))))
    base = base.withColumn("_hits", F.coalesce("_quick", _hits_of_pairs(F.col("_pairs"))))
    repeat = F.aggregate(F.transform("_hits", lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_hits", i + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)
    known = facts(F.col("_w"), F.col("_text"))
    names = [*known, "n_repeat_words"]
    whole = F.array(F.lit(None).cast("struct<a: bigint, b: bigint>"))
    base = base.select("doc_id", F.xxhash64("_text").alias("text_hash"), *(c.alias(k) for k, c in known.items()), repeat.alias("n_repeat_words"), F.concat(whole, _neighbours(F.col("_m"))).alias("_g"))
    # Outer, so that no size filter is inferred (it would repeat the expressions). The null in front stands for the row itself: it keeps texts without grams and counts repeated rows.
    each = _buckets(base.select("doc_id", "text_hash", *names, F.explode_outer("_g").alias("_z")), "doc_id", "text_hash", *names)
    one, two = (F.broadcast(llr.select(F.col("bucket").alias(c), F.col("llr").alias(f"_{c}"))) for c in ("one", "two"))
    value = F.coalesce("_one", F.lit(0.0)) + F.coalesce("_two", F.lit(0.0))
    scored = each.join(one, "one", "left").join(two, "two", "left").groupBy("doc_id", "text_hash").agg(
        *(F.max(x).alias(x) for x in names), F.sum(value).alias("_sum"), (F.count("one") + F.count("two")).alias("_grams"), F.sum(F.col("one").isNull().cast("int")).alias("_copies")
    )
    score = F.round(F.coalesce(F.col("_sum") / F.nullif(F.col("_grams"), F.lit(0)), F.lit(0.0)), 9)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = scored.select("doc_id", "text_hash", *names, failed.alias("base_failed"), score.alias("llr"), "_copies")
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    return each_copy(out, "_copies", "_copy").drop("_copy")

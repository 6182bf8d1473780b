"""Exact duplicates of texts, with the copies of heavy texts taken out before any shuffle.

Texts are known by the SHA-256 of what they are after lower-casing A-Z only; a null text is an empty one. Of equal texts
the row of the largest doc_id stays (null is the smallest); of rows alike in doc_id and text one stays.

A Misra-Gries summary of each partition keeps a fixed number of counters. Summaries are added up by digest; a digest that a
share of 2 in `counters` of all rows or more has is surely among those that reach half of that, and there are at most
`counters` + 1 of these. They are counted exactly, which gives each its winner, and those that really reach the share are
broadcast: their rows are settled where they are read. All other digests go through an ordinary shuffle, where no group
holds more than a small share of the rows.

An empty table gives an empty result; other columns may have any names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licenses import LOWER, UPPER
from .shared import columns, discard, free, staged

#: Counters of a summary: bounds what is broadcast (this many digests, one more at most) and what a partition hands on.
COUNTERS = 1024


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased. lower() does just that to a text of ASCII characters alone, and much faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _reduced(counts: dict, counters: int) -> dict:
    """The Misra-Gries step: where there are too many counters, all lose what the first one too many has."""
    if len(counts) <= counters:
        return counts
    less = sorted(counts.values(), reverse=True)[counters]
    return {x: n - less for x, n in counts.items() if n > less}


def summaries(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """digest, n: each partition's summary. n is never above the digest's rows there, and below them by at most one in
    counters + 1 of the partition's rows."""

    def count(batches):
        counts: dict = {}
        for b in batches:
            for x in b["digest"].value_counts().to_pylist():
                counts[x["values"]] = counts.get(x["values"], 0) + x["counts"]
            counts = _reduced(counts, counters)
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["digest", "n"])

    return digests.select("digest").mapInArrow(count, "digest binary, n bigint")


def heavy(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """digest, size, best of the digests that at least one in counters + 1 of the rows have, and two rows at least, among
    them all that twice that share has. rows: digest, best (a struct that orders them)."""
    least = max(2, -(-rows.count() // (counters + 1)))
    likely = summaries(rows, counters).groupBy("digest").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("digest")
    likely = staged(likely, "exact-likely")
    counted = rows.join(F.broadcast(likely), "digest").groupBy("digest").agg(F.count("*").alias("size"), F.max("best").alias("top"))
    out = staged(counted.filter(F.col("size") >= least), "exact-heavy")
    discard(likely)
    return out


def _groups(rows: DataFrame, counters: int) -> tuple[DataFrame, DataFrame]:
    """digest, size, top of the heavy digests, and of all others."""
    winners = heavy(rows, counters)
    rest = rows.join(F.broadcast(winners), "digest", "left_anti")
    return winners, staged(rest.groupBy("digest").agg(F.count("*").alias("size"), F.max("best").alias("top")), "exact-rest")


def _keyed(docs: DataFrame) -> DataFrame:
    """digest, best of each row, as a table: texts are hashed once, and the numbers of rows are the same in each reading."""
    at = dict(zip(docs.columns, columns(docs)))
    digest = F.unhex(F.sha2(normalised(at["text"]), 256))
    return staged(docs.select(digest.alias("digest"), F.struct(at["doc_id"].alias("doc_id"), F.monotonically_increasing_id().alias("row")).alias("best")), "exact-rows")


def marks(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs (doc_id, text)."""
    rows = _keyed(docs)
    winners, others = _groups(rows, counters)
    settled = rows.join(F.broadcast(winners), "digest")
    shuffled = rows.join(F.broadcast(winners), "digest", "left_anti").join(others, "digest")
    facts = settled.unionByName(shuffled)
    return facts.select("best.doc_id", F.col("top.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("best.row") == F.col("top.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay, with all their columns. Of rows alike in doc_id and text the one whose columns hash to
    the smallest number stays. A heavy text's other rows go where they are read; their texts are not shuffled."""
    rows = _keyed(docs)
    winners, others = _groups(rows, counters)
    digest, best, keep, key = free(docs, "_digest", "_best", "_keep", "_key")
    texts = docs.withColumn(digest, F.unhex(F.sha2(normalised(F.col("text")), 256)))
    named = lambda df: df.select(F.col("digest").alias(key), F.col("top.doc_id").alias(keep))
    stays = F.col("doc_id").eqNullSafe(F.col(keep))
    first = texts.join(F.broadcast(named(winners)), F.col(digest) == F.col(key)).filter(stays)
    rest = texts.join(F.broadcast(named(winners)), F.col(digest) == F.col(key), "left_anti")
    rest = rest.join(named(others), F.col(digest) == F.col(key)).filter(stays)
    one = first.unionByName(rest).groupBy(digest).agg(F.min_by(F.struct(*columns(docs)), F.xxhash64(*columns(docs))).alias(best))
    return one.select(f"{best}.*")

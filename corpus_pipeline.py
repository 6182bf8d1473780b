"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on every document that its predecessor left, and returns a DataFrame; all
but the last return the columns of documents, whatever other columns there are and however they are named. run() writes
each stage's result to the shared folder and reads it again; what a stage staged on its way goes then.

Rows in all stages: a null text is empty. A row is known by its doc_id and its text, so rows that share a doc_id, or have
none, are told apart by their texts, and rows that share both are treated alike. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwork.llm import mixing, ngrams, packing, quality, suffixes
from tarnwork.llm.queries import token_file
from tarnwork.llm.shared import columns, discard, free, opened, partitions, release, staged, table, words_of


def _met(docs: DataFrame, key: str, facts: DataFrame, how: str, text: Column | None = None) -> DataFrame:
    """docs, with its text's hash as key, joined with facts (doc_id, text_hash and more) on both; nulls meet nulls."""
    names = free(docs, "_id", "_hash")
    right = facts.withColumnsRenamed(dict(zip(("doc_id", "text_hash"), names)))
    keyed = docs.withColumn(key, F.xxhash64(F.col("text") if text is None else text))
    return keyed.join(right, F.col("doc_id").eqNullSafe(F.col(names[0])) & F.col(key).eqNullSafe(F.col(names[1])), how)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars again, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; of the others each row stays as it is. Without a text, or with fewer than
    fifty words, a document fails the base rules and goes. A ratio that is the threshold keeps; texts are read whole."""
    verdicts = quality.judge(docs, quality.ratios(docs, table(spark, sf_dir, "labels")))
    gone = staged(verdicts.filter(~F.col("kept")).select("doc_id", "text_hash").distinct(), "rejected")
    key = free(docs, "_key")[0]
    return _met(docs, key, gone, "left_anti", F.coalesce("text", F.lit(""))).drop(key)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) one document stays: the one of smallest doc_id, null last, and of
    several the one whose text's hash is smallest, once. Documents without words are linked with nothing and stay all."""
    rows = ngrams.join(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    stays = rows.filter("label is not null").groupBy("label").agg(least.alias("m")).select("m.doc_id", "m.text_hash")
    empty = rows.filter("label is null").select("doc_id", "text_hash").distinct()
    stays = staged(stays.withColumn("once", F.lit(True)).unionAll(empty.withColumn("once", F.lit(False))), "kept")
    key, nth, once = free(docs, "_key", "_nth", "_once")
    kept = _met(docs, key, stays.withColumnRenamed("once", once), "inner")
    # Rows alike in id and text: which of them stays is told by their other columns, so that it is the same again.
    first = Window.partitionBy("doc_id", key).orderBy(F.xxhash64(*columns(docs)))
    kept = kept.withColumn(nth, F.row_number().over(first)).filter(~F.col(once) | (F.col(nth) == 1))
    return kept.select(*columns(docs))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a document of smaller doc_id has are cut out; every document stays, a text that is cut
    away whole as an empty one. Rows of one doc_id do not cut each other. n_chars is counted anew."""
    return _counted(suffixes.deduplicate(docs, keep_columns=True))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each reading of a document that the schedule takes, in the order of its slots; a reading in part has its
    words alone. Documents without words are never taken; a null source is one of its own. n_chars is counted anew.

    Rows are written by slot: partition p has the p-th stretch of the schedule, in order.
    """
    sizes = staged(mixing.measured(docs), "mix-sizes")
    begin, length, slot, epoch = free(docs, "_begin", "_length", "_slot", "_epoch")
    pieces = mixing.mix(sizes, mixing.plan_sources(sizes)).groupBy("doc_id", "source", "text_hash", "copy", "epoch")
    pieces = staged(pieces.agg(F.min("start").alias(begin), F.sum("length").alias(length), F.min("slot").alias(slot)), "mix-pieces")
    # Copies of a row are read alike but for where they stand, so a reading is told by its number among them.
    key, copy, of, other = free(docs, "_key", "_copy", "_copy_of", "_source_of")
    nth = Window.partitionBy("doc_id", "source", key).orderBy(F.xxhash64(*columns(docs)))
    numbered = docs.withColumn(key, F.xxhash64("text")).withColumn(copy, F.row_number().over(nth) - 1)
    names = free(docs, "_id", "_hash")
    right = pieces.withColumnsRenamed({"doc_id": names[0], "text_hash": names[1], "copy": of, "source": other, "epoch": epoch})
    same = F.col("doc_id").eqNullSafe(F.col(names[0])) & F.col(key).eqNullSafe(F.col(names[1])) & (F.col(copy) == F.col(of)) & F.col("source").eqNullSafe(F.col(other))
    taken = numbered.join(right, same)
    words = words_of(F.col("text"))
    whole = (F.col(begin) == 0) & (F.col(length) == F.size(words))
    part = F.array_join(F.slice(words, (F.col(begin) + 1).cast("int"), F.col(length).cast("int")), " ")
    read = taken.withColumn("text", F.when(whole, F.col("text")).otherwise(part)).select(*columns(docs), slot, epoch)
    last = pieces.agg(F.max(slot)).first()[0]
    n = partitions(spark)
    if last is not None:
        read = read.repartitionById(n, F.floor(F.col(slot) * n / (last + 1)).cast("int")).sortWithinPartitions(slot, epoch, "doc_id")
    return _counted(read.select(*columns(docs)))


def sum_of_squares_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens. An empty document is its end token alone; a very long one
    fills whole sequences and a rest; repeated rows are packed each."""
    return packing.pack_documents(docs, token_file())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mixing_to_weights),
    ("packing", sum_of_squares_packing),
]

#: Hashed statistics, components and packing have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before = opened()
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
        release(before, docs)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)

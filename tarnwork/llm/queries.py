"""The operators' queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, classifier, exact, infill, itemsets, licenses, media, mixing, ngrams, oracles, packing, quality, sharding, suffixes
from .shared import table


def token_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, sf_dir, "documents")).drop("spans")


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), token_file())


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.text_media(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op5_zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archives.round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.ratios(docs, table(spark, sf_dir, "labels"))).drop("text_hash")


def op7_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.join(table(spark, sf_dir, "documents"), 3, 90, 100).drop("text_hash", "label")


def op11_basket_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = itemsets.closed(table(spark, sf_dir, "sale_lines"), "sale_id", "item_id")
    return itemsets.with_rules(mined, itemsets.rules(mined)).withColumn("rules_sha256", F.sha2("rules", 256)).drop("rules")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.fill(table(spark, sf_dir, "documents"))
    again = infill.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.marks(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (
        op1_license_scans,
        op2_suffix_array_dedup,
        op3_sum_of_squares_packing,
        op4_media_columns,
        op5_zip_archives,
        op6_quality_rules,
        op7_sampled_splitters,
        op8_quality_classifier,
        op9_mixing,
        op10_ngram_jaccard_join,
        op11_basket_itemsets,
        op12_fill_in_middle,
        op13_exact_dedup,
    )}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()

"""Source bundles: manifest checks, file choice, byte budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def manifest_errors(files: DataFrame) -> DataFrame:
    """files (submission_id, path, size, sha256) with the first error of each entry, null where it is sound."""
    copies = F.count("*").over(Window.partitionBy("submission_id", "path"))
    return files.withColumn(
        "error",
        F.when(F.col("path").isNull(), "path is not text").when(~T.safe_path(F.col("path")), "unsafe path").when(copies > 1, "repeated path").when(F.col("size").isNull() | (F.col("size") < 0), "bad size").when(F.col("sha256").isNotNull() & ~T.is_digest(F.col("sha256")), "bad digest"),
    )


def read_budget(files: DataFrame, per_file: int | Column, total: int | Column, key: str = "submission_id", order: str = "path", size: str = "size") -> DataFrame:
    """bytes_read and omission_reason when files are read in order under both budgets.

    A file takes the least of its size, the file budget and what files before it left of the total; what files before
    took is the running sum of their capped sizes, as far as the total reaches.
    """
    per_file, total = (x if isinstance(x, Column) else F.lit(x) for x in (per_file, total))
    capped = F.least(F.col(size), per_file)
    before = F.coalesce(F.sum(capped).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(total - before, F.lit(0))
    read = F.least(capped, left)
    reason = F.when((left <= 0) | (read < capped), "total_budget").when(F.col(size) > per_file, "file_budget")
    return files.withColumn("bytes_read", read.cast("long")).withColumn("omission_reason", reason)


def totals(read: DataFrame, key: str = "submission_id", size: str = "size") -> DataFrame:
    return read.groupBy(key).agg(
        F.count("*").alias("file_count"), F.sum(size).cast("long").alias("declared_bytes"), F.sum("bytes_read").cast("long").alias("total_bytes_read"), F.count_if(F.col("omission_reason").isNotNull()).alias("truncated_count"), F.bool_or(F.col("omission_reason").isNotNull()).alias("incomplete")
    )


def first_root(files: DataFrame, root: str, *key: str) -> DataFrame:
    """Of the roots that have a file, the first one's copy."""
    return files.groupBy(*key).agg(F.min_by(F.struct(*(c for c in files.columns if c not in key)), root).alias("_r")).select(*key, "_r.*")


def effective_limit(policy: int, *limits: str):
    """The largest of the policy's limit and the lab's positive ones."""
    return F.greatest(F.lit(policy), *(F.when(F.col(x) > 0, F.col(x)) for x in limits))


def verify_copy(declared: DataFrame, actual: DataFrame, *key: str) -> DataFrame:
    """Entries whose copy is missing or differs in size or digest."""
    a = actual.select(*key, F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    return declared.join(a, list(key), "left").filter(F.col("_size").isNull() | (F.col("_size") != F.col("size")) | ~F.col("sha256").eqNullSafe(F.col("_sha"))).drop("_size", "_sha")

"""File and report sources, all through Spark's readers."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators import bundles, rules

MAX_REPORT = 2 << 20


def replaced_utf8(column):
    """UTF-8 with replacement characters for what is not."""

    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))

    return run(column)


def tree(spark: SparkSession, root: str, root_ord: int = 0) -> DataFrame:
    """root_ord, path (below root), size, raw of every file under a root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "/" + root.split("://")[-1].strip("/") + "/"
    return raw.select(F.lit(root_ord).alias("root_ord"), F.substring_index(F.col("path"), base, -1).alias("path"), F.col("length").alias("size"), F.col("content").alias("raw"))


def bundles_from_roots(spark: SparkSession, roots: list[str], manifest: DataFrame, labs: DataFrame, policy: rules.Policy = rules.Policy()) -> DataFrame:
    """Source files of each submission (submission_id, lab_id, path, size), chosen by its lab's patterns and read under its
    lab's budgets from the first root that has them (root/submission/path). labs: lab_id, lab_definition."""
    found = None
    for i, r in enumerate(roots):
        t = tree(spark, r, i)
        found = t if found is None else found.unionByName(t)
    found = bundles.first_root(found.withColumn("submission_id", F.substring_index("path", "/", 1)).withColumn("path", F.regexp_replace("path", r"^[^/]*/", "")), "root_ord", "submission_id", "path")
    wanted = rules.source_files(manifest, rules.lab_rules(labs, policy=policy), policy)
    wanted = bundles.read_budget(wanted, F.col("file_limit"), F.col("total_limit")).drop("file_limit", "total_limit")
    met = wanted.join(found.select("submission_id", "path", "raw"), ["submission_id", "path"], "left")
    return met.withColumn("content", replaced_utf8(F.expr("substring(raw, 1, cast(bytes_read as int))"))).drop("raw")


def reports(spark: SparkSession, pattern: str, schema: StructType | str, most: int = MAX_REPORT) -> DataFrame:
    """JSON reports, one a file, with their owner's folder; large and malformed ones are left out."""
    raw = spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(pattern)
    return raw.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("_size")).filter(F.col("_size") <= most).withColumn("owner", T.basename(T.parent(F.col("_path")))).drop("_path", "_size")


def ready_runs(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """metadata.json of the run folders that have a _READY mark, which Spark's readers hide; executors look for it."""
    import pyarrow.fs as pafs

    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.json").json(root)
    rows = rows.select("*", T.parent(F.col("_metadata.file_path")).alias("_folder"))

    @F.pandas_udf("boolean")
    def ready(folders: pd.Series) -> pd.Series:
        def one(folder: str) -> bool:
            files, path = pafs.FileSystem.from_uri(folder)
            return files.get_file_info(f"{path}/_READY").type == pafs.FileType.File

        return folders.map(one)

    return rows.filter(ready("_folder")).drop("_folder")


def signed_payloads(envelopes: DataFrame, verify) -> DataFrame:
    """Envelopes (payload, key_id, signature, in unpadded base64url) with the payload's text, for those that verify.

    verify(payload, key_id, signature) -> bool runs on batches of rows; signature checks need a library of the caller's.
    An envelope whose payload or signature cannot be decoded never verifies.
    """
    out = envelopes.withColumn("_raw", T.base64url(F.col("payload"))).withColumn("_sig", T.base64url(F.col("signature")))

    @F.pandas_udf("boolean")
    def good(raw: pd.Series, key: pd.Series, sig: pd.Series) -> pd.Series:
        return pd.Series([r is not None and s is not None and bool(verify(bytes(r), k, bytes(s))) for r, k, s in zip(raw, key, sig)], dtype=bool)

    out = out.filter(good("_raw", "key_id", "_sig"))
    return out.filter("_raw is not null").select("*", F.col("_raw").cast("string").alias("text"), F.sha2("_raw", 256).alias("payload_digest")).drop("_raw", "_sig")


def closed(text, schema: str, keys: list[str]):
    """A JSON object of exactly these keys, typed; null if a key is missing, more or ill-typed."""
    have = F.array_sort(F.map_keys(F.from_json(text, "map<string,string>")))
    return F.when(F.size(F.array_except(have, F.array(*map(F.lit, keys)))) + F.size(F.array_except(F.array(*map(F.lit, keys)), have)) == 0, F.from_json(text, schema))


def tree_digest(files: DataFrame, *key: str) -> DataFrame:
    """SHA-256 over path, NUL and content digest of each file, in the order of paths."""

    @F.pandas_udf("string")
    def run(groups: pd.Series) -> pd.Series:
        def one(rows):
            h = hashlib.sha256()
            for r in rows:
                h.update(r["path"].encode() + b"\0" + bytes.fromhex(r["sha"]))
            return h.hexdigest()

        return groups.map(one)

    return files.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha")))).alias("_g")).select(*key, run("_g").alias("digest"))

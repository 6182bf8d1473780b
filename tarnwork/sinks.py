"""Writes that never change what is there: content-addressed keys, parts beside parts, one claim a version.

A table is a folder of parts under the versions of ``versions``; ``stored`` reads its last version. Each part has the rows
and, by bucket of the key's hash, the keys with digests of their rows. A writer reads the key digests of the buckets that
its own rows touch, writes its part, and claims the next version. If another writer was first, what that one added is
looked at: keys of other buckets cannot conflict, so the claim is made again; else the rows are checked anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions
from .storage import discard, file_system, staged

#: Buckets of keys, and parts after which a table's parts are put together.
BUCKETS, MOST_PARTS = 64, 32
_BUCKET = "key_bucket"


class Conflict(ValueError):
    """A key is there with other content."""


def stored(spark: SparkSession, path: str, version: versions.Version | None = None) -> DataFrame:
    """The rows of a version of a table, the last if none is given."""
    v = version or versions.current(spark, path)
    if not v.parts:
        raise FileNotFoundError(f"no version of {path}")
    return spark.read.parquet(*(f"{versions.part_path(path, p)}/rows" for p in v.parts))


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _key_paths(path: str, parts: dict, touched: list[int]) -> list[str]:
    """Folders of the keys in the buckets touched: others are neither listed nor read."""
    return [f"{versions.part_path(path, p)}/keys/{_BUCKET}={b}" for p, note in parts.items() for b in touched if b in note["buckets"]]


def _keys(spark: SparkSession, path: str, parts: dict, touched: list[int], schema) -> DataFrame | None:
    found = _key_paths(path, parts, touched)
    return spark.read.schema(schema).parquet(*found) if found else None


def _write_part(rows: DataFrame, keys: DataFrame, path: str) -> tuple[str, dict]:
    """Its name, and the buckets that it has keys of."""
    part = versions.new_part()
    rows.write.parquet(f"{versions.part_path(path, part)}/rows")
    folder = f"{versions.part_path(path, part)}/keys"
    keys.repartition(_BUCKET).sortWithinPartitions(keys.columns[0]).write.partitionBy(_BUCKET).parquet(folder)
    files, where = file_system(rows.sparkSession, folder)
    names = (s.getPath().getName().partition("=") for s in files.listStatus(where) if s.isDirectory())
    return part, {"buckets": sorted(int(b) for name, _, b in names if name == _BUCKET)}


def _commit(spark: SparkSession, path: str, touched: list[int], build) -> versions.Version:
    """build(version) writes a part against a version and returns what _write_part does, or None for nothing to write."""
    seen = versions.current(spark, path)
    while True:
        made = build(seen)
        if made is None:
            return seen
        part, note = made
        while True:
            try:
                done = versions.publish(spark, path, seen, seen.parts | {part: note})
                return compact(spark, path) if len(done.parts) >= MOST_PARTS else done
            except versions.Lost:
                before, seen = seen, versions.current(spark, path)
                added = [x["buckets"] for p, x in seen.parts.items() if p not in before.parts]
                if any(set(x) & set(touched) for x in added):
                    break
        versions.drop(spark, path, part)


def compact(spark: SparkSession, path: str) -> versions.Version:
    """Put a table's parts together to one; if another writer comes first, its version stands and nothing is done."""
    seen = versions.current(spark, path)
    if len(seen.parts) < 2:
        return seen
    paths = [versions.part_path(path, p) for p in seen.parts]
    keys = [spark.read.option("basePath", f"{p}/keys").parquet(f"{p}/keys") for p in paths]
    every = keys[0]
    for k in keys[1:]:
        every = every.unionByName(k)
    part, note = _write_part(spark.read.parquet(*(f"{p}/rows" for p in paths)), every, path)
    try:
        return versions.publish(spark, path, seen, {part: note})
    except versions.Lost:
        versions.drop(spark, path, part)
        return versions.current(spark, path)


def create_only(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS, volatile: tuple[str, ...] = ()) -> versions.Version:
    """Append rows whose key is new. Equal content under a known key is nothing to do; other content is a conflict, and then
    nothing is written. Volatile columns are no content: of rows that differ in them alone the first stays."""
    spark = rows.sparkSession
    body = F.sha2(F.to_json(F.struct(*sorted(c for c in rows.columns if c not in volatile))), 256)
    fresh = rows.withColumns({"_body": body, _BUCKET: _bucket(key, buckets)})
    fresh = staged(fresh.dropDuplicates([key, "_body"]), "create-rows")
    try:
        if fresh.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").take(1):
            raise Conflict(f"one {key} comes with different content")
        touched = sorted(r[0] for r in fresh.select(_BUCKET).distinct().collect())  # as many as there are buckets, at most

        def build(seen: versions.Version) -> tuple[str, dict] | None:
            new, old = fresh, _keys(spark, path, seen.parts, touched, fresh.select(key, "_body").schema)
            if old is not None:
                old = old.withColumnRenamed("_body", "_old")
                if fresh.join(old, key).filter("_body <> _old").take(1):
                    raise Conflict(f"a {key} is there with other content")
                new = fresh.join(old, key, "left_anti")
            if new.isEmpty():
                return None
            return _write_part(new.select(*rows.columns), new.select(key, "_body", _BUCKET), path)

        return _commit(spark, path, touched, build)
    finally:
        discard(fresh)


def write_manifest(manifest: DataFrame, path: str, key: str = "run_id", volatile: str = "generated_at") -> DataFrame:
    """One row a run. Written again with all but its time equal, the stored row stands; else it is a conflict."""
    create_only(manifest, path, key, volatile=(volatile,))
    return stored(manifest.sparkSession, path)


def record_reviews(reviews: DataFrame, path: str) -> None:
    """The ledger keeps conclusive reviews alone."""
    create_only(reviews.filter("decision <> 'inconclusive'"), path, "review_key")


def write_results(results: DataFrame, folder: str) -> None:
    """Results by task; every try by task and content."""
    create_only(results.filter("error is null"), f"{folder}/results", "task_key")
    attempt = F.concat_ws("-", "task_key", F.sha2(F.to_json(F.struct(*sorted(results.columns))), 256))
    create_only(results.withColumn("attempt_key", attempt), f"{folder}/attempts", "attempt_key")


def write_summary(summary: DataFrame, folder: str) -> str:
    """A clean run's summary is final; one with failures is one of its attempts. Returns where it went."""
    clean = summary.select("failed").first()["failed"] == 0
    where = f"{folder}/summary" if clean else f"{folder}/attempt_summaries"
    keyed = summary.withColumn("summary_key", F.lit("summary") if clean else F.sha2(F.to_json(F.struct(*sorted(summary.columns))), 256))
    create_only(keyed, where, "summary_key")
    return where


def owner_index(reports: DataFrame, path: str) -> DataFrame:
    """One derived row an owner: what is known of each submission, last first. Written anew from the reports."""
    row = F.struct("completed_at", "submission_id", "lab_id", "decision", "review_key")
    some = reports.groupBy("owner").agg(F.count("*").alias("reports"), F.count_if(F.col("decision") == "violation").alias("violations"), F.sort_array(F.collect_list(row), asc=False).alias("reviews"))
    some.write.mode("overwrite").parquet(path)
    return reports.sparkSession.read.parquet(path)


def pair_index(reports: DataFrame, path: str) -> DataFrame:
    """A folder a lab with its pairs, each under the smaller id first; Spark splits a large lab. Written anew from the reports."""
    low, high = F.least("first_id", "second_id"), F.greatest("first_id", "second_id")
    some = reports.select("lab_id", low.alias("low_id"), high.alias("high_id"), "decision", "relationship", "jaccard", "review_key", "completed_at")
    some.hint("rebalance", "lab_id").sortWithinPartitions("lab_id", "low_id", "high_id").write.mode("overwrite").partitionBy("lab_id").parquet(path)
    return reports.sparkSession.read.parquet(path)


def materialise(declared: DataFrame, files: DataFrame, path: str, *key: str) -> DataFrame:
    """Write the files (key, content) of a workspace, all or none: each must have its declared size and digest."""
    from .operators import bundles

    found = files.withColumn("size", F.octet_length("content").cast("long")).withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    if bad := bundles.verify_copy(declared, found, *key).take(1):
        raise Conflict(f"{'/'.join(str(bad[0][k]) for k in key)} is not the file declared")
    found.join(declared.select(*key), list(key), "left_semi").write.mode("overwrite").parquet(path)
    return files.sparkSession.read.parquet(path)


def append_events(events: DataFrame, path: str, states: tuple[str, ...], buckets: int = BUCKETS) -> versions.Version:
    """Known states only; the next numbers of each run. Writers of one run's events get different numbers."""
    from .operators import runs

    spark = events.sparkSession
    if events.filter(~F.col("state").isin(*states)).take(1):
        raise ValueError("unknown state")
    fresh = staged(runs.sequenced(events, "updated_at", "state").withColumn(_BUCKET, _bucket("run_id", buckets)), "event-rows")
    try:
        touched = sorted(r[0] for r in fresh.select(_BUCKET).distinct().collect())

        def build(seen: versions.Version) -> tuple[str, dict] | None:
            if fresh.isEmpty():
                return None
            new, old = fresh, _keys(spark, path, seen.parts, touched, fresh.select("run_id", F.col("sequence").cast("long").alias("_last")).schema)
            new = new.withColumn("sequence", F.col("sequence").cast("long"))
            if old is not None:
                have = old.groupBy("run_id").agg(F.max("_last").alias("_m"))
                new = new.join(have, "run_id", "left").withColumn("sequence", F.col("sequence") + F.coalesce("_m", F.lit(0))).drop("_m")
            last = new.groupBy("run_id", _BUCKET).agg(F.max("sequence").alias("_last")).select("run_id", "_last", _BUCKET)
            return _write_part(new.select(*events.columns, "sequence"), last, path)

        return _commit(spark, path, touched, build)
    finally:
        discard(fresh)

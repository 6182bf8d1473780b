"""Where submissions come from: a database query, rows in memory, or a table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = (
    "s.id", "s.owner", "s.lab_id", "s.score", "s.input_digest", "s.input_manifest", "s.lab_definition", "s.submitted_at", "s.status", "s.is_valid",
    "r.id AS active_run_id", "r.state AS run_state", "r.result_info AS run_result_info", "r.score AS run_score", "r.performance AS run_performance", "r.finished_at AS run_finished_at",
)
SCHEMA = (
    "id string, owner string, lab_id string, score bigint, input_digest string, input_manifest struct<files: array<struct<path: string, size: bigint, sha256: string>>>, "
    "lab_definition string, submitted_at timestamp, status string, is_valid boolean, active_run_id bigint, run_performance double"
)


def _quoted(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def catalogue_query(policy: str, minimum_score: int, cutoff, labs: Sequence[str] = (), owners: Sequence[str] = (), ids: Sequence[str] = (), limit: int | None = None) -> str:
    """One statement that the database answers from one snapshot; every predicate is in it."""
    best = policy == "best_only"
    score = "b.score" if best else "s.score"
    source = "best_scores b JOIN submissions s ON s.id = b.submission_id JOIN runs r ON r.id = s.active_run_id" if best else "submissions s LEFT JOIN runs r ON r.id = s.active_run_id"
    where = ["s.status = 'Success'", "s.is_valid", f"{score} >= {int(minimum_score)}", f"s.submitted_at <= {_quoted(cutoff)}"]
    where += [f"{c} IN ({', '.join(map(_quoted, v))})" for c, v in (("s.lab_id", labs), ("s.owner", owners), ("s.id", ids)) if v]
    if limit is not None and limit <= 0:
        raise ValueError("a limit must be positive")
    tail = "" if limit is None else f" LIMIT {int(limit)}"
    return f"SELECT {', '.join(COLUMNS)} FROM {source} WHERE {' AND '.join(where)} ORDER BY s.owner, s.lab_id, s.submitted_at, s.id{tail}"


def from_database(spark: SparkSession, url: str, query: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """One partition, read only: parallel readers would not share a snapshot. Land it as a table before wide work."""
    reader = spark.read.format("jdbc").option("url", url).option("query", query).option("sessionInitStatement", "SET default_transaction_read_only = on; SET statement_timeout = '30s'")
    return reader.options(**dict(options or {})).load()


def from_rows(spark: SparkSession, rows: Sequence) -> DataFrame:
    return spark.createDataFrame(list(rows), SCHEMA)


def manifest_files(submissions: DataFrame) -> DataFrame:
    """submission_id, lab_id, path, size, sha256: a row an entry; a submission without files has none."""
    return submissions.select(F.col("id").alias("submission_id"), "lab_id", F.explode("input_manifest.files").alias("_f")).select("submission_id", "lab_id", "_f.*")


#: A source of submissions: any function of a session.
Catalogue = Callable[[SparkSession], DataFrame]

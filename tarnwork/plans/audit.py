"""The audit as one call: from submissions and files to tasks, verdicts and a summary, as named DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import bundles, delta, identity, reports, rules, selection, similarity, verdicts
from ..sources import files as sources
from ..sources.settings import Settings
from ..storage import staged

#: A reviewer gets tasks and returns task_key, decision, confidence, error; model calls happen behind it.
Reviewer = Callable[[DataFrame], DataFrame]


def replay(table: DataFrame) -> Reviewer:
    """A reviewer that answers from a table of verdicts by task_key; tasks without one fail."""
    return lambda tasks: tasks.join(table.select("task_key", "decision", "confidence"), "task_key", "left").select("task_key", "decision", "confidence", F.when(F.col("decision").isNull(), "no verdict").alias("error"))


@dataclass(frozen=True)
class Request:
    cutoff: str
    labs: tuple[str, ...] = ()
    owners: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()
    limit: int | None = None
    mode: str = "exhaustive"
    patterns: tuple[str, ...] = ()
    settings: Settings = field(default_factory=Settings)
    versions: identity.Versions = field(default_factory=identity.Versions)


@dataclass(frozen=True)
class Result:
    history: DataFrame
    best: DataFrame
    delta_files: DataFrame
    entities: DataFrame
    candidates: DataFrame
    exclusions: DataFrame
    tasks: DataFrame
    results: DataFrame
    summary: DataFrame


def plan(request: Request, submissions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """History, best and plan-mode tasks in order: a review of each best one, and exact duplicates of the whole history."""
    s = request.settings
    history = selection.eligible(submissions, s.minimum_score, F.lit(request.cutoff).cast("timestamp"), request.labs, request.owners, request.ids)
    best = selection.best(history)
    single = best if request.limit is None else selection.snapshot(best, request.limit)
    pairs = similarity.exact_pairs(history, "input_digest", "exact_submission")
    tasks = single.select(F.lit("compliance").alias("kind"), "lab_id", F.col("id").alias("first_id"), F.lit(None).cast("string").alias("second_id")).unionByName(
        pairs.select(F.lit("exact_duplicate").alias("kind"), "lab_id", "first_id", "second_id")
    )
    key = F.sha2(F.concat_ws("\0", "kind", "lab_id", "first_id", F.coalesce("second_id", F.lit(""))), 256)
    return history, best, reports.in_order(tasks.withColumn("task_key", key))


def basis_of(baseline: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """lab_id, basis_commit, basis_tree_digest, document_digest: what a lab's reviews rest on, from its baseline's files
    (lab_id, path, content, revision) and its documents (lab_id, text)."""
    tree = sources.tree_digest(baseline, "lab_id").withColumnRenamed("digest", "basis_tree_digest")
    out = baseline.groupBy("lab_id").agg(F.max("revision").alias("basis_commit")).join(tree, "lab_id")
    if documents is None:
        return out.withColumn("document_digest", F.lit(""))
    return out.join(documents.select("lab_id", F.sha2(F.col("text").cast("binary"), 256).alias("document_digest")), "lab_id", "left")


def with_identity(tasks: DataFrame, entities: DataFrame, basis: DataFrame, request: Request) -> DataFrame:
    """Tasks with identity and review_key: a single one's from its submission, a pair's from both."""
    s, v = request.settings, request.versions
    facts = entities.select("id", "input_digest", "delta_digest", "lab_definition_digest")
    side = lambda n: facts.toDF(*(f"{n}_{c}" for c in facts.columns))
    met = tasks.join(side("first"), "first_id").join(side("second"), "second_id", "left").join(basis, "lab_id", "left")
    one = met.filter(F.col("second_id").isNull()).withColumns({"id": F.col("first_id"), "input_digest": F.col("first_input_digest"), "delta_digest": F.col("first_delta_digest"), "lab_definition_digest": F.col("first_lab_definition_digest")})
    one = identity.keyed(one, identity.single(v, max_file_bytes=s.file_bytes, max_total_bytes=s.total_bytes, prompt_evidence_chars=s.evidence_chars))
    both = met.filter(F.col("second_id").isNotNull()).withColumn("lab_definition_digest", F.sha2(F.concat_ws("\0", "first_lab_definition_digest", "second_lab_definition_digest"), 256))
    both = identity.keyed(both, identity.pair(
        v, band_size=s.band_size, jaccard_threshold=s.threshold, near_identical_threshold=verdicts.NEAR_IDENTICAL, num_permutations=s.permutations, prompt_evidence_chars=s.evidence_chars, shingle_size=s.shingle_size,
    ))
    names = [*tasks.columns, "identity", "review_key"]
    return one.select(*names).unionByName(both.select(*names))


def run(request: Request, submissions: DataFrame, files: DataFrame, baseline: DataFrame, ledger: DataFrame, reviewer: Reviewer, documents: DataFrame | None = None) -> Result:
    """files: submission_id, lab_id, path, size, content. documents: lab_id, text. Deltas, entities and candidates are tables in the shared folder:
    several steps read each, and one plan of all of them would be too long to optimize."""
    s = request.settings
    history, best, _ = plan(request, submissions)
    policy, patterns, limits = rules.Policy(file_bytes=s.file_bytes, total_bytes=s.total_bytes), list(request.patterns), (s.file_bytes, s.total_bytes)
    if "lab_definition" in history.columns:  # each lab's own patterns and limits
        labs = rules.lab_rules(history.groupBy("lab_id").agg(F.max("lab_definition").alias("lab_definition")), policy=policy)
        files = rules.with_rules(files, labs, policy).drop("regex")
        patterns, limits = patterns or labs, (F.col("file_limit"), F.col("total_limit"))
    read = bundles.read_budget(files, *limits).drop("file_limit", "total_limit").withColumn("content", F.expr("substring(content, 1, cast(bytes_read as int))"))
    read = read.join(history.select(F.col("id").alias("submission_id")), "submission_id", "left_semi")
    incomplete = read.groupBy("submission_id").agg(F.bool_or(F.col("omission_reason").isNotNull()).alias("incomplete"))
    found = staged(delta.build(read, baseline, patterns), "audit-deltas")
    whole = history.select(F.col("id").alias("submission_id")).join(incomplete, "submission_id", "left").withColumn("incomplete", F.coalesce("incomplete", F.lit(False)))
    digests = delta.digests(found, whole)
    shingles = similarity.shingle_sets(found, s.shingle_size)
    changed = found.select("submission_id").distinct().withColumn("changed_files", F.lit(True))
    definition = hashing.canonical_sha256(F.col("lab_definition")) if "lab_definition" in history.columns else F.lit("")
    entities = (
        history.select("id", "owner", "lab_id", "submitted_at", "input_digest", definition.alias("lab_definition_digest")).join(digests.select(F.col("submission_id").alias("id"), F.col("digest").alias("delta_digest"), "incomplete"), "id")
        .join(shingles.withColumnRenamed("submission_id", "id"), "id", "left").join(changed.withColumnRenamed("submission_id", "id"), "id", "left")
        .withColumn("shingles", F.coalesce("shingles", F.array().cast("array<string>"))).withColumn("changed_files", F.coalesce("changed_files", F.lit(False)))
    )
    entities = staged(entities, "audit-entities")
    candidates = staged(similarity.detect(entities, s.threshold, request.mode, s.permutations, s.band_size), "audit-candidates")
    single = best if request.limit is None else selection.snapshot(best, request.limit)
    tasks = single.select(F.lit("compliance").alias("kind"), "lab_id", F.col("id").alias("first_id"), F.lit(None).cast("string").alias("second_id"), F.lit(None).cast("string").alias("signal"), F.lit(None).cast("double").alias("jaccard"), F.lit(None).cast("string").alias("relationship")).unionByName(
        candidates.select(F.lit("plagiarism").alias("kind"), "lab_id", "first_id", "second_id", "signal", "jaccard", verdicts.relationship(F.col("signal"), F.col("jaccard")).alias("relationship"))
    )
    tasks = tasks.withColumn("task_key", F.sha2(F.concat_ws("\0", "kind", "lab_id", "first_id", F.coalesce("second_id", F.lit(""))), 256))
    tasks = with_identity(tasks, entities, basis_of(baseline, documents), request)
    stored = [reports.with_ledger(tasks.filter(F.col("kind") == k), ledger, k) for k in ("compliance", "plagiarism")]
    known = staged(reports.in_order(stored[0].unionByName(stored[1])), "audit-tasks")
    fresh = reviewer(known.filter(~F.col("cache_hit")))
    results = known.join(fresh, "task_key", "left").select("task_key", "review_key", "identity", "kind", "lab_id", "first_id", "second_id", "relationship", "cache_hit", F.coalesce("stored_decision", "decision").alias("decision"), F.coalesce("stored_confidence", "confidence").alias("confidence"), "error")
    return Result(history, best, found, entities, similarity.in_order(candidates), similarity.exclusions(entities), tasks, results, reports.run_summary(results))

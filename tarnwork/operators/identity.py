"""What a review is known by: everything that its verdict rests on, as canonical JSON, and that text's digest.

A stored verdict is found again only under the same inputs, deltas, basis, versions, model and parameters; a change of
any of them is another key, so nothing stale is ever reused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Versions:
    """What the caller fixes for a whole run."""

    rules: str = "1"
    prompt: str = "1"
    schema: str = "1"
    model: str = ""
    model_parameters: tuple[tuple[str, object], ...] = ()
    delta: str = "1"
    similarity: str = "1"
    tokenizer: str = "1"
    source_policy: str = "1"
    strategy: str = "whole"


def ordered(**fields) -> Column:
    """A struct whose fields are in the order of their names, as canonical JSON has them."""
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in sorted(fields.items())))


def canonical(value: Column) -> Column:
    """JSON without blanks; nulls are written. Keys are in order if the struct was made by ``ordered``.

    Doubles are written as Java does, which differs from other writers below 0.001 and from 10^7 on.
    """
    return F.to_json(value, {"ignoreNullFields": "false"})


def _identity(versions: Versions, kind: str, task_parameters: dict, **fields) -> Column:
    return ordered(
        task_type=kind, rules_version=versions.rules, prompt_version=versions.prompt, schema_version=versions.schema, model=versions.model,
        model_parameters=canonical(ordered(**dict(versions.model_parameters))) if versions.model_parameters else F.lit("{}"), task_parameters=canonical(ordered(**task_parameters)), **fields,
    )


def single(versions: Versions, **parameters) -> Column:
    """Identity of a compliance review. Columns: id, input_digest, delta_digest, lab_id and those of the basis."""
    return _identity(
        versions, "compliance", {"delta_version": versions.delta, "source_policy_version": versions.source_policy, "review_strategy": versions.strategy, **parameters},
        submission_ids=F.array("id"), input_digests=F.array("input_digest"), source_delta_digests=F.array("delta_digest"), **_basis(),
    )


def pair(versions: Versions, **parameters) -> Column:
    """Identity of a review of a pair. Columns: first_ and second_ of the ids and digests, signal, jaccard, the basis."""
    both = lambda c: F.array(f"first_{c}", f"second_{c}")
    return _identity(
        versions, "plagiarism", {"delta_version": versions.delta, "similarity_version": versions.similarity, "tokenizer_version": versions.tokenizer, "signal": F.col("signal"), "jaccard": F.col("jaccard"), **parameters},
        submission_ids=both("id"), input_digests=both("input_digest"), source_delta_digests=both("delta_digest"), **_basis(),
    )


def _basis() -> dict[str, Column]:
    return {c: F.coalesce(F.col(c), F.lit("")) for c in ("lab_id", "basis_commit", "basis_tree_digest", "document_digest", "lab_definition_digest")}


def keyed(tasks: DataFrame, identity: Column) -> DataFrame:
    """tasks with identity (canonical JSON) and review_key (its SHA-256)."""
    return tasks.withColumn("identity", canonical(identity)).withColumn("review_key", F.sha2("identity", 256))


def checked(ledger: DataFrame) -> DataFrame:
    """The ledger, whose reading fails at a row that is not what its key says."""
    sound = F.sha2("identity", 256) == F.col("review_key")
    wrong = F.raise_error(F.concat(F.lit("stored review does not have the identity of its key "), F.col("review_key"))).cast("string")
    return ledger.withColumn("review_key", F.when(F.coalesce(sound, F.lit(False)), F.col("review_key")).otherwise(wrong))


def differing_bases(requested: DataFrame, derived: DataFrame) -> DataFrame:
    """Labs whose requested basis is not the one derived here, with the columns that differ; a lab without one differs in all."""
    columns = sorted(c for c in requested.columns if c != "lab_id")
    have = derived.select("lab_id", *(F.col(c).alias(f"_{c}") for c in columns))
    apart = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns)))
    return requested.join(have, "lab_id", "left").select("lab_id", apart.alias("differs")).filter(F.size("differs") > 0)


def require_bases(requested: DataFrame, derived: DataFrame) -> None:
    if some := differing_bases(requested, derived).take(1):
        raise ValueError(f"the basis of {some[0]['lab_id']} differs in {', '.join(some[0]['differs'])}")

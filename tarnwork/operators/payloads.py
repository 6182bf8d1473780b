"""What a reviewer is given: deltas, sources and documents as JSON, each text cut to its share of the budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import evidence
from .identity import canonical, ordered

# What a prompt's document and definition may take at most.
DOCUMENT, DEFINITION = 80_000, 30_000
LEAST_PART = 16_000


def limits(total: int, document: Column, definition: Column) -> dict[str, Column]:
    """Characters for the document, the definition, the delta and the sources, each at least one."""
    one, n = F.lit(1), F.lit(total)
    doc = F.greatest(one, F.least(F.length(document), F.lit(min(DOCUMENT, total // 3))))
    lab = F.greatest(one, F.least(F.length(definition), F.lit(min(DEFINITION, total // 8))))
    rest = F.greatest(F.lit(2), n - doc - lab)
    delta = F.greatest(one, F.floor(rest * 2 / 3)).cast("int")
    return {"document_chars": doc, "definition_chars": lab, "delta_chars": delta, "source_chars": F.greatest(one, rest - delta)}


def delta_files(deltas: DataFrame, budget: DataFrame) -> DataFrame:
    """submission_id, files, truncated: changed files with their hunks, each hunk cut to its share of its file's share.

    budget: submission_id, delta_chars. Texts are met with their shares by (submission, path, hunk); only sizes are shared out.
    deltas are read several times, so they should be a table.
    """
    hunks = deltas.select("submission_id", "path", "baseline_kind", "baseline_revision", F.length("added_text").alias("added_chars"), F.length("removed_text").alias("removed_chars"), F.posexplode("hunks").alias("index", "hunk"))
    sizes = hunks.select("submission_id", "path", "index", F.length("hunk.lines").cast("long").alias("size"))
    files = sizes.groupBy("submission_id", "path").agg(F.greatest(F.sum("size"), F.lit(1)).cast("long").alias("size")).withColumn("priority", T.evidence_priority(F.col("path")))
    shares = evidence.budgets(files.join(budget.select("submission_id", F.col("delta_chars").cast("long").alias("_most")), "submission_id"), "submission_id", "_most")
    name = F.concat_ws("\0", "submission_id", "path")
    each = sizes.withColumn("size", F.greatest("size", F.lit(1))).join(shares.select("submission_id", "path", F.col("budget").alias("_most")), ["submission_id", "path"])
    each = each.select(name.alias("file"), "submission_id", "path", "index", F.col("index").cast("string").alias("name"), "size", F.lit(1).alias("priority"), "_most")
    cut = evidence.budgets(each, "file", "_most", name="name").select("submission_id", "path", "index", "budget")
    h = lambda c: F.col(f"hunk.{c}")
    shown = hunks.join(cut, ["submission_id", "path", "index"]).withColumn("text", T.bounded(h("lines"), F.col("budget").cast("int"), "delta_hunk_budget"))
    one = F.struct("index", ordered(old_start=h("old_start"), old_count=h("old_count"), new_start=h("new_start"), new_count=h("new_count"), text=F.col("text")).alias("hunk"))
    kept = ["submission_id", "path", "baseline_kind", "baseline_revision", "added_chars", "removed_chars"]
    by_file = shown.groupBy(*kept).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["hunk"]).alias("hunks"), F.bool_or("text.truncated").alias("_cut"))
    whole = ordered(artifact=T.artifact_kind(F.col("path")), hunks=F.col("hunks"), **{c: F.col(c) for c in kept[1:]})
    return by_file.groupBy("submission_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", whole.alias("file")))), lambda x: x["file"]).alias("files"), F.bool_or("_cut").alias("truncated"))


def source_files(bundle: DataFrame, budget: DataFrame) -> DataFrame:
    """submission_id, files, omitted: build and run files, cut to their shares. bundle: submission_id, path, content, size,
    bytes_read, omission_reason. budget: submission_id, source_chars."""
    picked = F.coalesce(T.basename(F.col("path")).isin(*T.EXECUTION_NAMES), F.lit(False))
    omitted = bundle.groupBy("submission_id").agg(F.count_if(~picked).alias("omitted"))
    some = bundle.filter(picked).withColumnRenamed("size", "declared_bytes")
    sized = some.select("submission_id", "path", F.greatest(F.length("content"), F.lit(1)).cast("long").alias("size"), T.evidence_priority(F.col("path")).alias("priority"))
    shares = evidence.budgets(sized.join(budget.select("submission_id", F.col("source_chars").cast("long").alias("_most")), "submission_id"), "submission_id", "_most").select("submission_id", "path", "budget")
    shown = some.join(shares, ["submission_id", "path"])
    one = ordered(
        path=F.col("path"), artifact=T.artifact_kind(F.col("path")), content=T.bounded(F.col("content"), F.col("budget").cast("int"), "source_context_budget"), input_truncated=F.col("omission_reason").isNotNull(),
        declared_bytes=F.col("declared_bytes"), bytes_read=F.col("bytes_read"), omission_reason=F.col("omission_reason"),
    )
    files = shown.groupBy("submission_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", one.alias("file")))), lambda x: x["file"]).alias("files"))
    return omitted.join(files, "submission_id", "left")


def compliance(submissions: DataFrame, deltas: DataFrame, bundle: DataFrame, total: int) -> DataFrame:
    """submission_id, payload (JSON), incomplete. submissions: submission_id, owner, lab_id, score, document, definition,
    delta_digest, incomplete. A cut document, definition or hunk makes the evidence incomplete; cut sources do not."""
    share = submissions.select("*", *(c.alias(n) for n, c in limits(total, F.col("document"), F.col("definition")).items()))
    met = (
        share.join(delta_files(deltas, share).withColumnRenamed("files", "_d"), "submission_id", "left")
        .join(source_files(bundle, share).withColumnRenamed("files", "_s"), "submission_id", "left")
        .withColumn("_doc", T.bounded(F.col("document"), F.col("document_chars"), "document_budget"))
        .withColumn("_lab", T.bounded(F.col("definition"), F.col("definition_chars"), "lab_definition_budget"))
    )
    some = lambda c: F.coalesce(F.col(c), F.lit(False))
    payload = ordered(
        task="compliance_review", prompt_evidence_budget_chars=total,
        submission=ordered(id=F.col("submission_id"), owner=F.col("owner"), lab_id=F.col("lab_id"), score=F.col("score")),
        review_basis=ordered(experiment_document=F.col("_doc"), frozen_lab_definition_json=F.col("_lab")),
        baseline_delta=ordered(digest=F.col("delta_digest"), incomplete=F.col("incomplete"), files=F.col("_d")),
        source_context=ordered(files=F.col("_s"), omitted_unchanged_file_count=F.coalesce("omitted", F.lit(0))),
    )
    cut = some("incomplete") | some("truncated") | F.col("_doc.truncated") | F.col("_lab.truncated")
    return met.select("submission_id", canonical(payload).alias("payload"), cut.alias("incomplete"))


def chunks(items: DataFrame, key: str, order: list[str], most: int, overhead: int = 0) -> DataFrame:
    """Items (key, order, text and whatever else) split and dealt into prompts by what they take as JSON.

    A text over half a prompt is split with overlap first; a chunk is closed when the next item's JSON, with its comma,
    would take the prompt over most characters.
    """
    parts = items.withColumn("_p", F.explode(evidence.split(max(LEAST_PART, most // 2))("text"))).drop("text")
    whole = parts.select("*", "_p.*").drop("_p")
    shown = [c for c in whole.columns if c != key]
    sized = whole.withColumn("prompt_chars", F.length(F.to_json(F.struct(*shown))) + 2)
    return evidence.pack(sized, key, [*order, "part_index"], "prompt_chars", most, overhead)

"""Baseline deltas: which lines of a submitted file the baseline has not, and the other way."""

from __future__ import annotations

import difflib
import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import canonical
from ..storage import staged
from . import rules

HUNKS = "array<struct<old_start: bigint, old_count: bigint, new_start: bigint, new_count: bigint, lines: string>>"
CHANGE = f"struct<added_text: string, removed_text: string, hunks: {HUNKS}>"
CONTEXT = 3
#: Characters of baseline text that are broadcast at most, and file pairs that are compared before their results go out.
BROADCAST, TOGETHER = 1 << 25, 64


def compare(old: str, new: str) -> dict:
    """Added and removed text and hunks of one file."""
    a, b = (x.replace("\r\n", "\n").replace("\r", "\n").splitlines(keepends=True) for x in (old, new))
    match = difflib.SequenceMatcher(None, a, b, autojunk=False)
    changes = [c for c in match.get_opcodes() if c[0] != "equal"]
    hunks = []
    for group in match.get_grouped_opcodes(CONTEXT):
        text = []
        for kind, i, j, m, n in group:
            sides = [(" ", a[i:j])] if kind == "equal" else [("-", a[i:j]), ("+", b[m:n])]
            text += [sign + line for sign, part in sides for line in part]
        (_, i, _, m, _), (_, _, j, _, n) = group[0], group[-1]
        hunks.append({"old_start": i + 1, "old_count": j - i, "new_start": m + 1, "new_count": n - m, "lines": "".join(text)})
    return {"added_text": "".join(x for _, _, _, m, n in changes for x in b[m:n]), "removed_text": "".join(x for _, i, j, _, _ in changes for x in a[i:j]), "hunks": hunks}


def _changes(rows: DataFrame, old: str, new: str) -> DataFrame:
    """rows with _c, the CHANGE of two columns that go. A worker holds the texts and results of a few files at a time, not
    those of an Arrow batch; sizes are bounded by the file budget."""
    kept = [f for f in rows.schema if f.name not in (old, new)]

    def run(batches):
        kind = None
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                found = [compare(o or "", n or "") for o, n in zip(part.column(old).to_pylist(), part.column(new).to_pylist())]
                kind = kind or pa.struct([("added_text", pa.string()), ("removed_text", pa.string()), ("hunks", pa.list_(pa.struct([*((n, pa.int64()) for n in ("old_start", "old_count", "new_start", "new_count")), ("lines", pa.string())])))])
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(found, kind)], names=[*(f.name for f in kept), "_c"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{fields}, _c {CHANGE}")


def against_baseline(files: DataFrame, baseline: DataFrame) -> DataFrame:
    """Files (submission_id, lab_id, path, content, omission_reason) beside their baseline text; none is an addition.

    Few labs have many files each, so texts are not dealt by lab: a baseline within BROADCAST goes to the files. A larger
    one meets them by shuffle, as a table of its own, so that Spark splits what is hot."""
    base = staged(baseline.select("lab_id", "path", F.col("content").alias("baseline_text"), F.col("revision").alias("baseline_revision"), F.col("kind").alias("_kind")), "baseline")
    taken = base.agg(F.sum(F.coalesce(F.length("baseline_text"), F.lit(0)) + 64)).first()[0] or 0
    if taken <= BROADCAST:
        base = F.broadcast(base)
    out = files.filter("omission_reason is null").join(base, ["lab_id", "path"], "left")
    return out.withColumn("baseline_kind", F.coalesce("_kind", F.lit("submission_addition"))).withColumn("baseline_text", F.coalesce("baseline_text", F.lit(""))).drop("_kind")


def removed_files(files: DataFrame, baseline: DataFrame, patterns: list[str] | DataFrame) -> DataFrame:
    """Baseline files that a submission lacks although its lab's patterns ask for them. patterns: one list for all labs, or
    each lab's (the table of rules.lab_rules)."""
    if isinstance(patterns, DataFrame):
        return rules.absent(baseline, patterns, files).join(baseline, ["lab_id", "path"])
    subjects = files.select("submission_id", "lab_id").distinct()
    wanted = subjects.join(baseline.filter(T.matches_any(F.col("path"), patterns)), "lab_id")
    return wanted.join(files.select("submission_id", "path"), ["submission_id", "path"], "left_anti")


def build(files: DataFrame, baseline: DataFrame, patterns: list[str] | DataFrame | None = None) -> DataFrame:
    """Delta files. With patterns, missing baseline files count as removed; without, they are out of scope."""
    beside = against_baseline(files, baseline).filter("content <> baseline_text")  # before the Python stage
    found = _changes(beside.select("submission_id", "lab_id", "path", "baseline_kind", "baseline_revision", F.col("baseline_text").alias("_old"), F.col("content").alias("_new")), "_old", "_new")
    if isinstance(patterns, DataFrame) or patterns:
        gone = removed_files(files, baseline, patterns)
        named = gone.select("submission_id", "lab_id", "path", F.col("kind").alias("baseline_kind"), F.col("revision").alias("baseline_revision"), F.col("content").alias("_old"), F.lit("").alias("_new"))
        found = found.unionByName(_changes(named, "_old", "_new"))
    return found.select("submission_id", "lab_id", "path", "baseline_kind", "baseline_revision", "_c.*").filter("added_text <> '' or removed_text <> ''")


def digests(delta_files: DataFrame, submissions: DataFrame) -> DataFrame:
    """submission_id, digest, incomplete: SHA-256 of the canonical JSON of a submission's delta files by path."""

    @F.pandas_udf("string")
    def digest(files: pd.Series) -> pd.Series:
        names = ("path", "added_text", "removed_text", "baseline_kind", "baseline_revision")
        return files.map(lambda x: hashlib.sha256(canonical([{n: f[n] for n in names} for f in sorted(x if x is not None else [], key=lambda f: f["path"])]).encode()).hexdigest())

    part = F.struct("path", "added_text", "removed_text", "baseline_kind", "baseline_revision")
    held = delta_files.groupBy("submission_id").agg(F.collect_list(part).alias("_f"))
    return submissions.select("submission_id", "incomplete").join(held, "submission_id", "left").select("submission_id", digest("_f").alias("digest"), "incomplete")


def line_surplus(left: DataFrame, right: DataFrame, *key: str, text: str = "text") -> DataFrame:
    """Lines that left has more often than right, with how many more: a delta that forgets order, without Python."""
    count = lambda df, n: df.select(*key, F.explode(T.lines(F.col(text))).alias("line")).groupBy(*key, "line").agg(F.count("*").alias(n))
    both = count(left, "_l").join(count(right, "_r"), [*key, "line"], "left")
    return both.withColumn("surplus", F.col("_l") - F.coalesce("_r", F.lit(0))).filter("surplus > 0").drop("_l", "_r")


def fallback_hunk(removed, added):
    """All removed lines, then all added ones, as a single hunk."""
    ended = lambda x: F.regexp_extract_all(x, F.lit(r"([^\n]*\n|[^\n]+\z)"), F.lit(1))
    signed = lambda x, s: F.transform(ended(x), lambda line: F.concat(F.lit(s), line))
    return F.struct(
        F.lit(1).cast("long").alias("old_start"), F.size(ended(removed)).cast("long").alias("old_count"), F.lit(1).cast("long").alias("new_start"), F.size(ended(added)).cast("long").alias("new_count"),
        F.array_join(F.concat(signed(removed, "-"), signed(added, "+")), "").alias("lines"),
    )

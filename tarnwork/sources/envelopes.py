"""Closed schemas of signed payloads: exact field sets, kinds and values, as the first rule that a payload breaks.

A schema is a dict of a field to its kind, to a tuple of the values allowed (texts or whole numbers), to a schema (an object),
or to a list of one schema (a list of objects). The payloads' version and audience are the caller's, and checked. Kinds: text (not empty, trimmed), count, count?, positive, number?, digest, uuid, instant, nonce, object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MOST_SUBMISSIONS, MOST_MINUTES = 1000, 15
# The two payloads' fields.
REFERENCE = {"repository": "text", "revision": "text", "tree_digest": "digest", "path_prefix": "text"}
BASIS = {"commit": "text", "tree_digest": "digest", "document_digest": "digest", "source_path": "text", "document_path": "text", "public_references": [REFERENCE]}
RUN = {"id": "positive", "state": ("Success",), "result_info": "object", "score": "count?", "performance": "number?", "finished_at": "instant"}
MEMBER = {"id": "uuid", "owner": "text", "lab_id": "text", "score": "count", "input_digest": "digest", "submitted_at": "instant", "input_manifest": "object"}
ISSUED = {"model": "text", "rules_version": "text", "issued_at": "instant", "expires_at": "instant", "nonce": "nonce"}
REVIEW = ISSUED | {
    "source": ("manual", "nightly"), "prompt_version": "text", "tool_version": "text", "result_schema_version": "text", "schema_version": "version", "audience": "audience",
    "submission": MEMBER | {"lab_definition": "object", "active_run": RUN}, "basis": BASIS,
}
PAIRS = ISSUED | {
    "source": ("manual",), "prompt_version": ("plagiarism-v2",), "result_schema_version": ("plagiarism-result-v1",), "schema_version": "version", "audience": "audience",
    "target_submission_id": "uuid", "submissions": [MEMBER], "lab_definition": "object", "basis": BASIS,
}


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _value_error(v: Column, rule, name: str) -> Column:
    """What is wrong with a value (a variant) by a rule that is no schema; null if nothing is."""
    kind, text = _kind(v), _as(v, "string")
    is_text, is_count = kind == "STRING", kind == "BIGINT"
    absent = v.isNull() | (kind == "VOID")
    number = is_count | (kind == "DOUBLE") | kind.startswith("DECIMAL")
    if isinstance(rule, tuple):
        texts, numbers = [x for x in rule if isinstance(x, str)], [x for x in rule if not isinstance(x, str)]
        good = is_text & text.isin(*texts) if texts else number & _as(v, "double").isin(*map(float, numbers))
    else:
        good = {
            "text": is_text & (F.length(text) > 0) & (F.trim(text) == text), "nonce": is_text & F.length(text).between(16, 128) & (F.trim(text) == text),
            "digest": is_text & T.is_digest(text), "uuid": is_text & T.is_uuid(text), "instant": is_text & T.utc_instant(text).isNotNull(), "object": kind.startswith("OBJECT"),
            "count": is_count & (_as(v, "bigint") >= 0), "positive": is_count & (_as(v, "bigint") > 0), "count?": absent | (is_count & (_as(v, "bigint") >= 0)), "number?": absent | number,
        }[rule]
    what = "one of " + ", ".join(map(str, rule)) if isinstance(rule, tuple) else rule.rstrip("?")
    return F.when(~F.coalesce(good, F.lit(False)), F.lit(f"{name} is not {what}"))


def _first_error(values: Column, schema: dict, name: str) -> Column:
    found = F.transform(_as(values, "array<variant>"), lambda x: schema_error(x, schema, name))
    return F.get(F.filter(found, lambda e: e.isNotNull()), F.lit(0))


def schema_error(v: Column, schema: dict, name: str = "payload") -> Column:
    """The first rule of a schema that a value (a variant) breaks; null if none."""
    fields = F.json_object_keys(F.to_json(v))
    same = F.array_sort(fields) == F.array(*(F.lit(x) for x in sorted(schema)))
    errors = [F.when(~F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False)), F.lit(f"{name} is not an object")), F.when(~F.coalesce(same, F.lit(False)), F.lit(f"{name} has other fields"))]
    for field, rule in schema.items():
        value, where = F.try_variant_get(v, f"$.{field}", "variant"), f"{name}.{field}"
        if isinstance(rule, dict):
            errors.append(schema_error(value, rule, where))
        elif isinstance(rule, list):
            errors.append(F.when(~F.coalesce(_kind(value).startswith("ARRAY"), F.lit(False)), F.lit(f"{where} is not a list")))
            errors.append(_first_error(value, rule[0], f"{where}[]"))
        else:
            errors.append(_value_error(value, rule, where))
    return F.coalesce(*errors)


def window_error(v: Column, now: Column, minutes: int = MOST_MINUTES) -> Column:
    """Issued before it expires, for at most so long, and valid now."""
    issued, expires = (T.utc_instant(F.try_variant_get(v, f"$.{x}", "string")) for x in ("issued_at", "expires_at"))
    return (
        F.when(expires <= issued, "it expires before it is issued").when(expires - issued > F.expr(f"interval {minutes} minutes"), f"it is valid for more than {minutes} minutes")
        .when((now < issued) | (now >= expires), "it is not valid now")
    )


def _meant(schema: dict, version: int, audience: str) -> dict:
    return schema | {"schema_version": (version,), "audience": (audience,)}


def review_errors(payloads: DataFrame, now: Column, nightly_model: str, version: int, audience: str, text: str = "text") -> DataFrame:
    """payloads with the first error of each review payload (JSON), null where it is sound and of this version and audience."""
    v = F.try_parse_json(text)
    night = F.when((F.try_variant_get(v, "$.source", "string") == "nightly") & (F.try_variant_get(v, "$.model", "string") != nightly_model), "a nightly payload names another model")
    return payloads.withColumn("error", F.coalesce(F.when(v.isNull(), "not JSON"), schema_error(v, _meant(REVIEW, version, audience)), night, window_error(v, now)))


def pair_errors(payloads: DataFrame, now: Column, version: int, audience: str, text: str = "text") -> DataFrame:
    """payloads with the first error of each pair payload: its corpus is of 1 to 1000 different submissions of one lab, the target among them."""
    v = F.try_parse_json(text)
    member = lambda f: F.transform(F.try_variant_get(v, "$.submissions", "array<variant>"), lambda x: F.try_variant_get(x, f"$.{f}", "string"))
    ids, labs = member("id"), member("lab_id")
    corpus = (
        F.when(~F.size(ids).between(1, MOST_SUBMISSIONS), f"the corpus is not of 1 to {MOST_SUBMISSIONS} submissions").when(F.size(F.array_distinct(ids)) < F.size(ids), "a submission comes twice")
        .when(F.size(F.array_distinct(labs)) > 1, "submissions are of several labs").when(~F.array_contains(ids, F.try_variant_get(v, "$.target_submission_id", "string")), "the target is not in the corpus")
    )
    return payloads.withColumn("error", F.coalesce(F.when(v.isNull(), "not JSON"), schema_error(v, _meant(PAIRS, version, audience)), corpus, window_error(v, now)))


def corpus(payloads: DataFrame, now: Column, version: int, audience: str, text: str = "text") -> DataFrame:
    """target_id, id, owner, lab_id, score, input_digest, submitted_at, input_manifest, lab_definition: a row a submission of
    the pair payloads that are sound."""
    kind = "target_submission_id string, lab_definition string, submissions array<struct<id: string, owner: string, lab_id: string, score: bigint, input_digest: string, submitted_at: string, input_manifest: struct<files: array<struct<path: string, size: bigint, sha256: string>>>>>"
    sound = pair_errors(payloads, now, version, audience, text).filter("error is null")
    rows = sound.select(F.from_json(text, kind).alias("p")).select("p.target_submission_id", "p.lab_definition", F.explode("p.submissions").alias("s"))
    return rows.select(F.col("target_submission_id").alias("target_id"), "s.id", "s.owner", "s.lab_id", "s.score", "s.input_digest", T.utc_instant(F.col("s.submitted_at")).alias("submitted_at"), "s.input_manifest", "lab_definition")

"""Per-lab source rules as data: patterns and byte limits that each lab's JSON definition holds, and what files they choose.

Definitions are navigated with a guard at each step: what is not an object, a list, a text or a whole number where one
belongs counts as absent, and a definition that is no JSON has no rules. Globs become regexes inside a column, so labs
with different patterns meet in one table, one row a lab, which is joined to the files like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Where a definition holds its patterns and limits.
REQUIRED, ALLOWED = "$.spec.submissions.home.required", "$.spec.submissions.home.allow"
FILE_LIMITS = ("$.spec.submissions.home.maxFileBytes", "$.spec.submissions.upload.maxFileBytes")
TOTAL_LIMITS = ("$.spec.submissions.home.maxTotalBytes", "$.spec.submissions.upload.maxTotalBytes")
# The policy's names, suffixes and limits.
SOURCE_NAMES = ("CMakeLists.txt", "Makefile", "makefile", "compile.sh", "run.sh")
SOURCE_SUFFIXES = (".c", ".cc", ".cpp", ".cxx", ".cu", ".h", ".hpp", ".py", ".sh", ".cmake", ".yaml", ".yml", ".toml", ".json")
MAX_FILE_BYTES, MAX_TOTAL_BYTES = 256_000, 1_000_000


@dataclass(frozen=True)
class Policy:
    """What holds for every lab, and where definitions hold the rest."""

    names: tuple[str, ...] = SOURCE_NAMES
    suffixes: tuple[str, ...] = SOURCE_SUFFIXES
    file_bytes: int = MAX_FILE_BYTES
    total_bytes: int = MAX_TOTAL_BYTES
    required: str = REQUIRED
    allowed: str = ALLOWED
    file_limits: tuple[str, ...] = FILE_LIMITS
    total_limits: tuple[str, ...] = TOTAL_LIMITS


def texts_at(v: Column, path: str) -> Column:
    """The texts of the list at a path of a variant, in order; other elements are passed over, anything else has none."""
    items = F.try_variant_get(v, path, "array<variant>")
    is_list = F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("ARRAY")
    found = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    return F.coalesce(F.when(is_list, found), F.array().cast("array<string>"))


def text_at(v: Column, path: str) -> Column:
    """The text at a path; null if there is none or something else."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def whole_at(v: Column, path: str) -> Column:
    """The whole number at a path, as far as 64 bits go (the largest of these if it is beyond); true, 5.0 and "5" are none."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    wide = kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
    sign = F.signum(F.try_variant_get(v, path, "double"))
    most = F.when(sign > 0, F.lit((1 << 63) - 1)).otherwise(F.lit(-(1 << 63) + 1))
    return F.when(kind == "BIGINT", F.try_variant_get(v, path, "bigint")).when(wide, most)


def effective(v: Column, policy: int, paths: tuple[str, ...]) -> Column:
    """The largest of the policy's limit and the positive whole numbers at the paths."""
    found = (F.when(whole_at(v, p) > 0, whole_at(v, p)) for p in paths)
    return F.greatest(F.lit(policy).cast("long"), F.lit(0).cast("long"), *found)


def lab_rules(labs: DataFrame, definition: str = "lab_definition", policy: Policy = Policy()) -> DataFrame:
    """lab_id, required, allowed, regex (of all patterns; null if none can match), file_limit, total_limit of each lab.

    labs: lab_id and the definition, one row a lab."""
    v = F.try_parse_json(definition)
    known = labs.select("lab_id", v.alias("_v"))
    v = F.col("_v")
    lists = known.select("lab_id", texts_at(v, policy.required).alias("required"), texts_at(v, policy.allowed).alias("allowed"), effective(v, policy.file_bytes, policy.file_limits).alias("file_limit"), effective(v, policy.total_bytes, policy.total_limits).alias("total_limit"))
    return lists.select("lab_id", "required", "allowed", T.any_glob(F.concat("required", "allowed")).alias("regex"), "file_limit", "total_limit")


def with_rules(files: DataFrame, rules: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """files (lab_id, path and more) with regex, file_limit, total_limit; a lab without rules has the policy's limits."""
    met = files.join(rules.select("lab_id", "regex", "file_limit", "total_limit"), "lab_id", "left")
    return met.withColumns({"file_limit": F.coalesce("file_limit", F.lit(policy.file_bytes).cast("long")), "total_limit": F.coalesce("total_limit", F.lit(policy.total_bytes).cast("long"))})


def is_source(path: Column, regex: Column, policy: Policy = Policy()) -> Column:
    """By the policy's names and suffixes, or by a pattern of the file's lab."""
    known = T.basename(path).isin(*policy.names) | T.suffix(path).isin(*policy.suffixes)
    return F.coalesce(known | F.coalesce(F.rlike(path, regex), F.lit(False)), F.lit(False))


def source_files(files: DataFrame, rules: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The files (submission_id, lab_id, path, size) with safe paths that are sources in their lab, with its limits."""
    met = with_rules(files.filter(T.safe_path(F.col("path"))), rules, policy)
    return met.filter(is_source(F.col("path"), F.col("regex"), policy)).drop("regex")


def absent(baseline: DataFrame, rules: DataFrame, submitted: DataFrame) -> DataFrame:
    """submission_id, lab_id, path of the baseline's files that a lab's patterns ask of a submission and it does not have.

    baseline: lab_id, path. submitted: submission_id, lab_id, path, as declared."""
    wanted = baseline.join(rules.select("lab_id", "regex"), "lab_id").filter(F.coalesce(F.rlike(F.col("path"), F.col("regex")), F.lit(False))).select("lab_id", "path")
    each = submitted.select("submission_id", "lab_id").distinct().join(wanted, "lab_id")
    return each.join(submitted.select("submission_id", "path"), ["submission_id", "path"], "left_anti").select("submission_id", "lab_id", "path")

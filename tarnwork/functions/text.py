"""Column functions over source text, paths and identifiers. All of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that agree with Unicode-aware \w, \d and \s.
WORD, DIGIT, SPACE = r"[\p{L}\p{N}_]", r"\p{Nd}", r"\s\x0b\x1c-\x1f\x85\p{Z}"
# Fixed value: the code tokens, leftmost alternative first.
TOKEN = rf"[A-Za-z_]{WORD}*|0[xX][0-9A-Fa-f]+|{DIGIT}+(?:\.{DIGIT}+)?|==|!=|<=|>=|->|::|&&|\|\||<<|>>|[^{SPACE}]"
# Patterns of include lines, definitions and build scripts.
INCLUDE = r"(?im)^\s*(?:#\s*include\s*[<\"]([^>\"]+)[>\"]|include\s*['\"]([^'\"]+)['\"])"
DEFINE = rf"(?m)^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]{WORD}*)(?:[ \t]+([^/\r\n]+?))?[ \t]*(?://.*)?$"
DYNAMIC_BUILD = r"(?i)\b(?:aux_source_directory|execute_process|add_custom_command|meson|scons|bazel)\b"
MAKE_CALL = r"(?i)(?:^|[^A-Za-z0-9_])g?make(?:[^A-Za-z0-9_]|\z)"
BUILD_GLOB = r"(src/[A-Za-z0-9_./*?\[\]-]+)"
SHELL_PATH = r"src/(?:\$|`)"
ENTER_SOURCES = r"(?m)^\s*(?:cd|pushd)\s+(?:['\"])?src(?:/|['\"]|\s|$)"
# File classes of the audit.
COMPILED = (".c", ".cc", ".cpp", ".cxx", ".cu", ".f", ".f77", ".f90", ".f95", ".for")
HEADERS = (".h", ".hh", ".hpp", ".hxx", ".cuh", ".fh", ".inc")
EXECUTION_NAMES = ("CMakeLists.txt", "Makefile", "makefile", "compile.sh", "run.sh")
ARTIFACT_SUFFIXES = (".orig", ".bak", ".rej", ".swp")


def unix_newlines(x: Column) -> Column:
    return F.regexp_replace(x, "\r\n?", "\n")


def lines(x: Column) -> Column:
    """Lines without their ends; a last line end opens no further line."""
    return F.split(F.regexp_replace(unix_newlines(x), r"\n\z", ""), "\n")


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(f"({TOKEN})"), F.lit(1))


def windows(items: Column, k: int, separator: str = "\0") -> Column:
    """Distinct runs of k items, each joined to one string; fewer than k items are one run, none is no run.

    Runs are joined before equal ones go: Spark hashes strings there, but compares arrays pair by pair.
    """
    n = F.size(items)
    runs = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(items, i, k), separator))
    whole = F.array(F.array_join(items, separator))
    return F.array_distinct(F.when(n >= k, runs).when(n > 0, whole).otherwise(F.array().cast("array<string>")))


def identifiers(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(rf"(?<!{WORD})([A-Za-z_]{WORD}*)"), F.lit(1)))


def includes(x: Column) -> Column:
    """Targets of C and Fortran include lines."""
    both = (F.regexp_extract_all(x, F.lit(INCLUDE), F.lit(i)) for i in (1, 2))
    return F.zip_with(*both, lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b))


def definitions(x: Column) -> Column:
    """(name, value) of each #define; an empty value is null."""
    both = (F.regexp_extract_all(x, F.lit(DEFINE), F.lit(i)) for i in (1, 2))
    return F.zip_with(*both, lambda a, b: F.struct(a.alias("name"), F.nullif(F.trim(b), F.lit("")).alias("value")))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.].*(\.[^.]+)\z", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+\z", "")


def safe_path(path: Column) -> Column:
    """Relative, with plain segments only."""
    parts = F.forall(F.split(path, "/"), lambda p: ~p.isin("", ".", ".."))
    return F.coalesce((F.length(path) > 0) & ~F.contains(path, F.lit("\\")) & ~F.contains(path, F.lit("\0")) & parts, F.lit(False))


def literal(x: Column) -> Column:
    """Regex that a text alone matches."""
    return F.regexp_replace(x, r"([^A-Za-z0-9_])", r"\\$1")


def glob_regex(pattern: str, cross: bool = False) -> str:
    """Regex of a submission pattern: ** any, * within a segment, ? one such character. cross: * and ? meet / too."""
    out, i = "", 0
    inner = "." if cross else "[^/]"
    while i < len(pattern):
        if pattern.startswith("**", i) and not cross:
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + (f"{inner}*" if c == "*" else inner if c == "?" else re.escape(c)), i + 1
    return f"(?s)^(?:{out})\\z" if cross else f"(?d)^(?:{out})\\z"


def glob_column(pattern: Column) -> Column:
    """The same as a column, without its ends: null for a pattern that is empty, absolute or has an empty or dotted segment.

    Signs are escaped first, so that what stands for ** can be told from the * in it."""
    escaped = F.regexp_replace(pattern, r"([!-/:-@\[-`{-~])", r"\\$1")
    out = F.replace(F.replace(F.replace(escaped, F.lit(r"\*\*"), F.lit(".*")), F.lit(r"\*"), F.lit("[^/]*")), F.lit(r"\?"), F.lit("[^/]"))
    return F.when(safe_path(pattern), out)


def any_glob(patterns: Column) -> Column:
    """One regex for a list of globs; null if none of them is valid."""
    valid = F.filter(F.transform(patterns, glob_column), lambda x: x.isNotNull())
    return F.when(F.size(valid) > 0, F.concat(F.lit("(?d)^(?:"), F.array_join(valid, "|"), F.lit(")\\z")))


def matches_any(path: Column, patterns: list[str], cross: bool = False) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p, cross))
    return out


def is_source(path: Column, names=EXECUTION_NAMES, suffixes=COMPILED + HEADERS, patterns=()) -> Column:
    return basename(path).isin(*names) | suffix(path).isin(*suffixes) | matches_any(path, list(patterns))


def artifact_kind(path: Column) -> Column:
    return F.nullif(F.regexp_extract(basename(path), r"\.(orig|bak|rej|swp)\z", 1), F.lit(""))


def evidence_priority(path: Column) -> Column:
    return F.when(basename(path).isin(*EXECUTION_NAMES), 4).when(artifact_kind(path).isNotNull(), 1).otherwise(2)


def bounded(x: Column, most: int | Column, reason: str) -> Column:
    """The text's first characters, with what was cut and the whole text's digest."""
    n = most if isinstance(most, Column) else F.lit(max(1, most))
    cut = F.length(x) > n
    return F.struct(
        F.substr(x, F.lit(1), n).alias("text"), cut.alias("truncated"), F.length(x).cast("long").alias("original_chars"), F.least(F.length(x), n).cast("long").alias("included_chars"),
        F.when(cut, F.lit(reason)).alias("truncation_reason"), F.sha2(x.cast("binary"), 256).alias("sha256"),
    )


def has_cjk(x: Column) -> Column:
    return (F.length(F.trim(x)) > 0) & x.rlike(r"[\x{3400}-\x{9fff}]")


def is_uuid(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"), F.lit(False))


def is_digest(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def is_safe_component(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*\z"), F.lit(False))


def utc_instant(x: Column) -> Column:
    """RFC 3339 with an offset or Z; anything else is null."""
    return F.when(x.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)\z"), F.try_to_timestamp(x))


def base64url(x: Column) -> Column:
    """Bytes of unpadded base64url text; null if it is padded or holds other characters."""
    padded = F.concat(F.translate(x, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(x), F.lit(4))))
    return F.when(x.rlike(r"^[A-Za-z0-9_-]*\z"), F.unbase64(padded))


def route(url: Column) -> Column:
    """Segments of a URL's path, empty ones left out."""
    return F.filter(F.split(F.coalesce(F.regexp_extract(url, r"^(?:[a-z]+://[^/?#]*)?([^?#]*)", 1), F.lit("")), "/"), lambda p: p != "")


def build_tools(compile_text: Column, run_text: Column) -> Column:
    """Which build tools the scripts call, and whether they build dynamically."""
    both = F.concat_ws("\n", compile_text, run_text)
    return F.struct(
        F.contains(F.lower(both), F.lit("cmake")).alias("cmake"),
        compile_text.rlike(MAKE_CALL).alias("make"),
        both.rlike(DYNAMIC_BUILD).alias("dynamic"),
    )

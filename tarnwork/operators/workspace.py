"""Read-only evidence tools over workspace files (root, path, content)."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

MAX_LINES, MAX_LINE, MAX_DIFF, MAX_RESPONSE = 400, 1000, 300, 32 << 10


def numbered(files: DataFrame, *key: str) -> DataFrame:
    """A row a line, numbered from 1; an empty file has none."""
    return files.filter(F.col("content") != "").select(*key, F.posexplode(T.lines(F.col("content"))).alias("_p", "text")).select(*key, (F.col("_p") + 1).alias("line"), "text")


def search(files: DataFrame, needle: str, *key: str, case_sensitive: bool = True, most: int = MAX_LINE) -> DataFrame:
    """Lines that hold the literal text; files with NUL bytes are left out. The file test comes before the lines are made."""
    if not 1 <= len(needle) <= 512:
        raise ValueError("search text must have 1 to 512 characters")
    fold = (lambda x: x) if case_sensitive else F.lower
    what = F.lit(needle if case_sensitive else needle.lower())
    some = files.filter(~F.contains("content", F.lit("\0")) & F.contains(fold(F.col("content")), what))
    return numbered(some, *key).filter(F.contains(fold(F.col("text")), what)).withColumn("text", F.substring("text", 1, most))


def read_lines(files: DataFrame, first: int, last: int, *key: str) -> DataFrame:
    """A range of lines, at most MAX_LINES from its first."""
    return numbered(files, *key).filter(F.col("line").between(first, min(last, first + MAX_LINES - 1)))


def page(rows: DataFrame, order: list[str], cursor: int, size: int) -> DataFrame:
    """A page of rows in order, with the next cursor, null on the last page."""
    total = rows.agg(F.count("*").alias("_n"))
    return rows.orderBy(*order).offset(cursor).limit(size).join(F.broadcast(total)).withColumn("next_cursor", F.when(F.col("_n") > cursor + size, cursor + size)).drop("_n")  # total is one row


def fitting_page(rows: DataFrame, order: list[str], cursor: int, size: int, most: int = MAX_RESPONSE) -> DataFrame:
    """A page whose rows, as JSON, take at most so many bytes: its last rows go until they do. next_cursor follows what stays."""
    some = page(rows, order, cursor, size)
    body = [c for c in some.columns if c != "next_cursor"]
    sized = some.withColumn("_b", F.octet_length(F.to_json(F.struct(*body))) + 1)
    upto = Window.orderBy(*order)  # over one page
    kept = sized.withColumn("_upto", F.sum("_b").over(upto)).withColumn("_place", F.row_number().over(upto)).withColumn("_n", F.count("*").over(Window.partitionBy()))
    kept = kept.filter(F.col("_upto") <= most).withColumn("_kept", F.count("*").over(Window.partitionBy()))
    cut = F.when(F.col("_kept") < F.col("_n"), cursor + F.col("_kept")).otherwise(F.col("next_cursor"))
    return kept.withColumn("next_cursor", cut.cast("int")).drop("_b", "_upto", "_place", "_n", "_kept")


def inventory(files: DataFrame) -> DataFrame:
    """root, file_count, total_bytes, suffixes."""
    by = files.groupBy("root", F.when(T.suffix(F.col("path")) == "", "<none>").otherwise(T.suffix(F.col("path"))).alias("suffix")).agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes"))
    return by.groupBy("root").agg(F.sum("n").alias("file_count"), F.sum("bytes").alias("total_bytes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("suffix", "n")))).alias("suffixes"))


def line_count(content):
    """Line feeds, and one more for a last line without one."""
    feeds = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return (feeds + F.when((content != "") & ~F.endswith(content, F.lit("\n")), 1).otherwise(0)).cast("long")


def file_info(files: DataFrame, *key: str) -> DataFrame:
    c = F.col("content")
    return files.select(*key, F.octet_length(c).cast("long").alias("bytes"), F.sha2(c.cast("binary"), 256).alias("sha256"), F.contains(c, F.lit("\0")).alias("binary"), line_count(c).alias("lines"))


def tree(files: DataFrame, depth: int, *key: str) -> DataFrame:
    """Directories and files down to a depth, each once."""
    parts = F.split("path", "/")
    up_to = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth)))
    entries = F.transform(up_to, lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), F.when(i == F.size(parts), "file").otherwise("directory").alias("type"), i.alias("depth")))
    return files.select(*key, F.explode(entries).alias("_e")).select(*key, "_e.*").distinct()


def check_evidence(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """evidence (root, path, start_line, end_line) with the first error, null if the range lies in the file."""
    met = evidence.join(files.select("root", "path", line_count(F.col("content")).alias("_n")), ["root", "path"], "left")
    bad = F.col("start_line").isNull() | F.col("end_line").isNull() | (F.col("start_line") <= 0) | (F.col("end_line") < F.col("start_line"))
    return met.withColumn("error", F.when(bad, "evidence line range is invalid").when(F.col("_n").isNull(), "no such file").when(F.col("end_line") > F.col("_n"), "evidence line exceeds file line count")).drop("_n")


def tool_trace(calls: DataFrame, key: str) -> DataFrame:
    """Per run: calls, turns, distinct paths, bytes, and calls by tool. calls: key, turn, tool, path, bytes."""
    by = calls.groupBy(key, "tool").agg(F.count("*").alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("by_tool"))
    total = calls.groupBy(key).agg(F.count("*").alias("calls"), F.count_distinct("turn").alias("turns"), F.count_distinct("path").alias("paths"), F.sum("bytes").alias("bytes"))
    return total.join(by, key)


def unified_diff(old_column, new_column):
    @F.pandas_udf("array<string>")
    def run(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([list(difflib.unified_diff((o or "").splitlines(), (n or "").splitlines(), lineterm="")) for o, n in zip(old, new)])

    return run(old_column, new_column)


def compare_files(pairs: DataFrame, cursor: int = 0, most: int = MAX_DIFF, width: int = 2000) -> DataFrame:
    """A page of each pair's unified diff. pairs: baseline_text and content."""
    d = F.col("_d")
    shown = F.transform(F.slice(d, cursor + 1, most), lambda x: F.substring(x, 1, width))
    return pairs.withColumn("_d", unified_diff("baseline_text", "content")).withColumn("diff", shown).withColumn("next_cursor", F.when(F.size(d) > cursor + most, cursor + most)).drop("_d")


#: The tools by the name that a caller uses; each takes files (root, path, content) and its own arguments.
TOOLS = {"list_files": tree, "search": search, "read_lines": read_lines, "inventory": inventory, "file_info": file_info, "compare": compare_files}


def call(tool: str, files: DataFrame, *arguments, **options) -> DataFrame:
    if tool not in TOOLS:
        raise ValueError(f"no tool {tool}")
    return TOOLS[tool](files, *arguments, **options)

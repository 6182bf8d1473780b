"""Evidence for reviews: items, splits with overlap, chunks under a budget, weighted allocation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

MOST_OVERLAP = 6_000
PARTS = "array<struct<part_index: int, part_count: int, text: string, core_start: int, core_chars: int, prefix_chars: int, suffix_chars: int>>"


def items(delta_files: DataFrame, bundle_files: DataFrame) -> DataFrame:
    """Hunks of changed files and whole build and run files, with a common header."""
    hunks = delta_files.select("submission_id", "path", F.posexplode("hunks").alias("item_index", "_h")).select("submission_id", F.lit("delta_hunk").alias("kind"), "path", "item_index", F.col("_h.lines").alias("text"))
    files = bundle_files.filter(T.basename(F.col("path")).isin(*T.EXECUTION_NAMES)).select("submission_id", F.lit("execution_context").alias("kind"), "path", F.lit(0).alias("item_index"), F.col("content").alias("text"))
    return hunks.unionByName(files).withColumn("artifact", T.artifact_kind(F.col("path")))


def line_ends(text: str) -> np.ndarray:
    """The place behind each line feed."""
    return np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 10) + 1


def cores(ends: np.ndarray, size: int, most: int) -> np.ndarray:
    """Edges, from 0 to size, of stretches of at most so many characters that close at the last line end within them."""
    edges = [0]
    while edges[-1] < size:
        reach = edges[-1] + most
        last = int(np.searchsorted(ends, reach, "right"))
        closed = last > 0 and ends[last - 1] > edges[-1]
        edges.append(size if reach >= size else int(ends[last - 1]) if closed else reach)
    return np.array(edges, np.int64)


def split_text(text: str | None, most: int) -> list[dict]:
    """Parts whose cores make up the text, each with whole lines around it as far as an eighth of the budget allows.

    All places come from a table of line ends: a part opens at the first line that starts within its reach, and closes at
    the last that ends within it; without such a line, at the reach itself.
    """
    text = text or ""
    size, around = len(text), min(MOST_OVERLAP, most // 8)
    if size <= most:
        edges, around, ends = np.array([0, size]), 0, np.zeros(0, np.int64)
    else:
        ends = line_ends(text)
        edges = cores(ends, size, max(1, most - 2 * around))
    begin, close = edges[:-1], edges[1:]
    low, high = np.maximum(begin - around, 0), np.minimum(close + around, size)
    opens = np.append(ends, size + 1)[np.searchsorted(ends, low, "right")]
    low = np.where((low > 0) & (opens <= begin), opens, low)
    shuts = np.insert(ends, 0, 0)[np.searchsorted(ends, high, "right")]
    high = np.where((high < size) & (shuts > close), shuts, high)
    return [
        {"part_index": i, "part_count": len(begin), "text": text[x:y], "core_start": a - x, "core_chars": b - a, "prefix_chars": a - x, "suffix_chars": y - b}
        for i, (a, b, x, y) in enumerate(np.stack([begin, close, low, high], axis=1).tolist())
    ]


def split(most: int):
    @F.pandas_udf(PARTS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, most))

    return run


def pack(rows: DataFrame, key: str, order: list[str], size: str, most: int, overhead: int = 0) -> DataFrame:
    """chunk of each row: in order, a chunk is closed when the next row would take it over the limit.

    A fold over a key's sizes alone, in one pass; texts stay where they are and meet their chunk again by position.
    """

    def fold(sizes) -> list[int]:
        used, chunk, out = overhead, 0, []
        for s in sizes:
            if out and used + s > most:
                used, chunk = overhead, chunk + 1
            used += s
            out.append(chunk)
        return out

    @F.pandas_udf("array<int>")
    def chunks(sizes: pd.Series) -> pd.Series:
        return sizes.map(fold)

    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    sizes = numbered.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(size).cast("long").alias("s")))), lambda x: x["s"]).alias("_s"))
    placed = sizes.select(key, F.posexplode(chunks("_s")).alias("_p", "chunk")).select(key, (F.col("_p") + 1).alias("_i"), "chunk")
    return numbered.join(placed, [key, "_i"]).drop("_i")


def allocate(sizes: list[int], priorities: list[int], names: list[str], most: int) -> list[int]:
    """Shares of most in proportion to size times priority, none over its size; what is left goes round one by one,
    first to high priority, then large, then by name."""
    most = max(1, most)
    weights = [max(s, 1) * max(p, 1) for s, p in zip(sizes, priorities)]
    out = [min(s, max(1, most * w // sum(weights))) for s, w in zip(sizes, weights)]
    left = most - sum(out)
    turn = sorted(range(len(sizes)), key=lambda i: (-priorities[i], -sizes[i], names[i]))
    while left > 0 and (short := [i for i in turn if out[i] < sizes[i]]):
        # Whole rounds at once: as many as the nearest to its size and what is left allow.
        rounds = min(left // len(short), min(sizes[i] - out[i] for i in short))
        for i in short if rounds else short[:left]:
            out[i] += rounds or 1
        left -= rounds * len(short) if rounds else min(left, len(short))
    return out


def budgets(rows: DataFrame, key: str, most: int | str, name: str = "path", size: str = "size", priority: str = "priority") -> DataFrame:
    """rows with budget, by key; a key's rows are its bundle's files, bounded by the file limits. most: a number, or the
    column that has it for the key (which goes)."""
    given = most if isinstance(most, str) else None
    kept = [c for c in rows.columns if c != given]

    @F.pandas_udf("array<bigint>")
    def shares(sizes: pd.Series, priorities: pd.Series, names: pd.Series, limits: pd.Series) -> pd.Series:
        return pd.Series([allocate(s.tolist(), p.tolist(), n.tolist(), int(m)) for s, p, n, m in zip(sizes, priorities, names, limits)])

    # A key's rows as one row: Arrow then has batches of many keys, where a group a key would have one of few rows each.
    limit = (F.first(given) if given else F.lit(most)).cast("long")
    held = rows.groupBy(key).agg(F.collect_list(F.struct(*kept)).alias("_r"), limit.alias("_most"))
    column = lambda c, kind: F.transform("_r", lambda r: r[c].cast(kind))
    shared = held.withColumn("_b", shares(column(size, "long"), column(priority, "long"), column(name, "string"), F.col("_most")))
    return shared.select(F.explode(F.arrays_zip("_r", "_b")).alias("_x")).select("_x._r.*", F.col("_x._b").alias("budget"))


def referenced_definitions(hunks: DataFrame, unchanged: DataFrame) -> DataFrame:
    """Definitions in unchanged files that a hunk's identifiers name. hunks: submission_id, path, item_index, text."""
    used = hunks.select("submission_id", "path", "item_index", F.explode(T.identifiers(F.col("text"))).alias("symbol"))
    known = unchanged.select("submission_id", F.col("path").alias("defined_in"), F.explode(T.definitions(F.col("content"))).alias("_d")).select("submission_id", "defined_in", F.col("_d.name").alias("symbol"), F.col("_d.value").alias("value"))
    return used.join(known, ["submission_id", "symbol"]).filter(F.col("path") != F.col("defined_in"))


def coverage(spans: DataFrame, *key: str, start: str = "start", end: str = "end") -> DataFrame:
    """key.., spans, stretches, covered: how many spans [start, end) there are, how many stretches they make together, and
    how long these are. Spans that overlap or touch are one stretch; empty ones cover nothing."""
    some = spans.filter(F.col(start) < F.col(end)).select(*key, F.col(start).alias("_a"), F.col(end).alias("_b"))
    # Equal spans once, with their number: what a window has to sort is what differs.
    each = some.groupBy(*key, "_a", "_b").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*key).orderBy("_a", "_b")
    before = F.max("_b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = each.withColumn("_before", before)
    adds = F.greatest(F.col("_b") - F.greatest("_a", F.coalesce("_before", F.col("_a"))), F.lit(0))
    opens = F.col("_before").isNull() | (F.col("_a") > F.col("_before"))
    return new.groupBy(*key).agg(F.sum("_n").alias("spans"), F.count_if(opens).alias("stretches"), F.sum(adds).alias("covered"))


def statistics(delta_files: DataFrame, bundle_files: DataFrame) -> DataFrame:
    """submission_id and counts of what its evidence is made of: files, bytes read and cut ones of its bundle; files and hunks
    of its delta (a file without hunks counts as one); build and run files, cut ones of these, and files left out as unchanged."""
    runs = T.basename(F.col("path")).isin(*T.EXECUTION_NAMES)
    cut = F.col("omission_reason").isNotNull()
    whole = bundle_files.groupBy("submission_id").agg(
        F.count("*").alias("file_count"), F.sum("bytes_read").cast("long").alias("bytes_read"), F.count_if(cut).alias("truncated_file_count"), F.count_if(runs).alias("context_file_count"),
        F.count_if(runs & cut).alias("truncated_context_file_count"), F.count_if(~runs).alias("omitted_unchanged_file_count"),
    )
    changed = delta_files.groupBy("submission_id").agg(F.count("*").alias("delta_file_count"), F.sum(F.greatest(F.size("hunks"), F.lit(1))).cast("long").alias("hunk_count"))
    return whole.join(changed, "submission_id", "left").fillna(0, ["delta_file_count", "hunk_count"])

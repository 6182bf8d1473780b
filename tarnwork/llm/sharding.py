"""Shards of near-equal bytes by sampled splitters, in DataFrame functions only.

Rows are ranged by the hash of their text, so that equal texts stand together. Splitters are quantiles of a bounded
sample drawn with chances in proportion to size, ``PER_SHARD`` ranges a shard. Ranges that turn out overfull are subdivided: a
text that alone outweighs a range becomes a range of its own. Shards are whole ranges, cut from their order at the
splitters nearest to equal bytes, after the heavy texts are dealt to the lightest shards; so equal texts share a shard.
Only a text with more bytes than a shard is dealt on: its copies go to as few shards as equal bytes allow, by rank.

What the driver holds is bounded by the number of shards: splitters, ranges and heavy texts. Rows are numbered in parts
of a range, as many as it takes to keep a part small, whose sizes stay in a table.

Rows: a null text has no bytes; every row has one byte more than its text. Repeated rows, and rows without an id, are
placed each. Ties in hash order go by id, then by place in the input; a very long text is one row like any other. Other
columns are not looked at, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import staged

SHARDS = 16
#: Ranges to a shard, sampled rows to a range, and rows that are numbered together, about.
PER_SHARD, SAMPLES, PART_ROWS = 64, 32, 1_000


def _below(splitters: list[int]):
    """Number of splitters at or below a row's key; two levels, so 2 * sqrt(n) comparisons."""

    def count(some):
        if not some:
            return F.lit(0)
        return F.size(F.filter(F.array(*map(F.lit, some)), lambda s: s <= F.col("k1")))

    step = max(1, round(len(splitters) ** 0.5))
    coarse = splitters[step - 1 :: step]
    out = None
    for i in range(len(coarse) + 1):
        value = F.lit(i * step) + count(splitters[i * step : (i + 1) * step - 1])
        out = F.when(F.col("_c") == i, value) if out is None else out.when(F.col("_c") == i, value)
    return count(coarse), out


def quantiles(drawn: list[tuple[int, float]], ranges: int) -> list[int]:
    """Different keys at the ranges' edges, from (key, weight) of a sample."""
    weight, seen, marks = sum(w for _, w in drawn), 0.0, []
    for key, w in sorted(drawn):
        seen += w
        if len(marks) < ranges - 1 and seen * ranges >= (len(marks) + 1) * weight:
            marks += [key] * min(ranges - 1 - len(marks), int(seen * ranges / weight) - len(marks))
    return sorted(set(marks))


def deal(units: list[tuple[tuple, int, int]], heavy: set, shards: int) -> dict[tuple, list[int]]:
    """Shards of each unit (key, rows, bytes): several, by rank, only for a heavy text that outweighs a shard.

    Heavy units go first, by weight, each to the shards that are lightest then; all others, in order, fill the shards up
    to a common level, each cut at the edge nearest to it.
    """
    total = sum(b for *_, b in units)
    load, out = [0.0] * shards, {}
    for key, n, size in sorted((u for u in units if u[0] in heavy), key=lambda u: (-u[2], u[0])):
        parts = min(n, shards, -(-size * shards // total))
        chosen = sorted(sorted(range(shards), key=lambda s: (load[s], s))[:parts])
        for s in chosen:
            load[s] += size / parts
        out[key] = chosen
    rest = sum(u[2] for u in units if u[0] not in heavy)
    # The level at which what the shards still take is the rest.
    level, order = 0.0, sorted(load)
    for i in range(1, shards + 1):
        level = (rest + sum(order[:i])) / i
        if i == shards or level <= order[i]:
            break
    edges, upto = [], 0.0
    for x in load:
        upto += max(0.0, level - x)
        edges.append(upto)
    at = 0
    for key, _, size in sorted(u for u in units if u[0] not in heavy):
        out[key] = [min(shards - 1, bisect.bisect_right(edges, at + size / 2))]
        at += size
    return out


def splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Edges of the ranges, from a sample of about SAMPLES rows to a range. A row's chance is its share of all bytes times
    the sample's size; one that is due more than one sample counts that often."""
    due = F.col("size") * F.lit(ranges * SAMPLES / max(1, total))
    luck = F.pmod(F.xxhash64("k1", "k2", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.filter(luck < due).select("k1", F.greatest(due, F.lit(1.0)).alias("w")).collect()
    return quantiles([(r["k1"], r["w"]) for r in drawn], ranges)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot."""
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k1"), F.xxhash64("doc_id").alias("k2"),
        F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("u"),  # a table from here on, so it stays as it is
    )
    rows = staged(rows, "shard-keys")
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    ranges = PER_SHARD * shards
    coarse, fine = _below(splitters(rows, total, ranges) if n else [])
    placed = rows.withColumn("_c", coarse).withColumn("_range", fine).drop("_c")
    # Overfull ranges are looked at text by text; at most as many texts as ranges outweigh a range.
    most = (total or 0) / ranges
    full = [r["_range"] for r in placed.groupBy("_range").agg(F.sum("size").alias("b")).collect() if r["b"] > most]
    texts = placed.filter(F.col("_range").isin(full)).groupBy("_range", "k1", "size", "text_crc32").agg(F.sum("size").alias("b")).filter(F.col("b") > most).select("_range", "k1", "size", "text_crc32").collect()
    texts.sort(key=tuple)
    names = [(r["k1"], r["size"], r["text_crc32"], i + 1) for i, r in enumerate(texts)]
    heavy = spark.createDataFrame(names, "k1 long, size long, text_crc32 long, _heavy int")
    placed = placed.join(F.broadcast(heavy), ["k1", "size", "text_crc32"], "left").withColumn("_heavy", F.coalesce("_heavy", F.lit(0)))
    key = ["_range", "_heavy"]
    sizes = placed.groupBy(*key).agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
    units = [((r["_range"], r["_heavy"]), r["n"], r["b"]) for r in sizes]
    where = deal(units, {u[0] for u in units if u[0][1]}, shards)
    info, begin = [], [0] * shards
    for (r, h), count, _ in sorted(units):
        to = where[r, h]
        edges = [i * count // len(to) for i in range(len(to) + 1)]
        info.append((r, h, -(-count // PART_ROWS), to, edges, [begin[s] for s in to]))
        for s, a, b in zip(to, edges, edges[1:]):
            begin[s] += b - a
    facts = spark.createDataFrame(info, "_range int, _heavy int, _parts long, _to array<int>, _edges array<long>, _begin array<long>")
    # Of a range's rows, equal texts stay in one part, but for a heavy one's.
    part = F.pmod(F.when(F.col("_heavy") > 0, F.col("u")).otherwise(F.xxhash64("k1", F.lit(7))), F.col("_parts"))
    dealt = placed.join(F.broadcast(facts), key).withColumn("_part", part)  # as many rows as ranges and heavy texts
    counts = dealt.groupBy(*key, "_part").agg(F.count("*").alias("_n"))
    counts = counts.select(*key, "_part", (F.sum("_n").over(Window.partitionBy(*key).orderBy("_part")) - F.col("_n")).alias("_before"))
    along = Window.partitionBy(*key, "_part").orderBy("k1", "k2", "doc_id", "size", "text_crc32", "u")
    ranked = dealt.withColumn("_i", F.row_number().over(along)).join(counts, [*key, "_part"]).withColumn("_rank", F.col("_before") + F.col("_i") - 1)
    nth = F.size(F.filter("_edges", lambda e: e <= F.col("_rank"))) - 1
    return ranked.withColumn("_nth", nth).select("doc_id", "size", "text_crc32", F.get("_to", "_nth").alias("shard"), (F.col("_rank") - F.get("_edges", "_nth") + F.get("_begin", "_nth")).alias("slot"))

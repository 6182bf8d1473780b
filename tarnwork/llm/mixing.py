"""Mixing of sources to target weights along a low-discrepancy schedule.

Slots 0 .. 2**b - 1 are met in time in van der Corput order: slot i's point is i with its bits reversed, and the source
whose share of the cumulative weights holds that point takes the slot. Every prefix of the schedule then has each source
near its share. A source's slots are ranked in time; its documents, shuffled by hash, form a stream that is cut into
blocks of equal tokens and read again from the start while its target isn't met; the slot of rank r takes block r.

Targets share ``factor`` times all tokens by weight; none exceeds ``most`` times its source's tokens, and what that cuts
off is shared again by weight among the others. Sources are a table, however many they are; the driver holds their sums
and the sizes of that table's partitions.

Rows: a null text has no words, and documents without words are never taken. Repeated rows are taken each; a very long
text is cut over as many blocks as it fills. Null is a source of its own, after all others; ties in hash order go by id.
Other columns are not looked at, whatever their names. An empty table, or one without words, gives no pieces.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import SPACE_RUN, each_copy, partitions, staged

WEIGHTS = (3, 1, 2)
#: Words in a block, about; slots at least; rows in a shuffled stretch of a source, about; slots in a stretch of time.
BLOCK, SLOTS, STRETCH, TIME = 1024, 1 << 12, 1_000, 1 << 16


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, text_hash, copy: a row for each document; copies of a row count from 0."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SPACE_RUN.replace("[", "[^"))).cast("long")
    rows = docs.select("doc_id", "source", words.alias("size"), F.xxhash64("text").alias("text_hash")).groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("_n"))
    return each_copy(rows, "_n", "copy")


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with sid, their place from 0 by code point of the name, null last, and done, what is taken before them.

    Sorted by range; places and sums go on from partition to partition by the partitions' own totals, which are few.
    """
    spark = sources.sparkSession
    order = F.col("source").asc_nulls_last()
    # A table, so that its partitions are the same in all that follows.
    ranged = staged(sources.repartitionByRange(partitions(spark), order).withColumn("_p", F.spark_partition_id()), "mix-ranged")
    at, before = 0, []
    for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():
        before.append((r["_p"], at))
        at += r["n"]
    offsets = F.broadcast(spark.createDataFrame(before, "_p int, _before long"))
    return ranged.join(offsets, "_p").withColumn("sid", F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1).drop("_before")


def _unit(sources: DataFrame, budget: float, most: float) -> float:
    """Tokens for a weight of one, when sources that would exceed their most are held to it. Each round is an aggregate;
    it holds more sources than the last, or it is the last."""
    left, held = sources.agg(F.sum("weight")).first()[0], 0
    unit = budget / left if left else 0.0
    while True:
        over = F.col("weight") * unit > F.lit(most) * F.col("source_size")
        some = sources.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.lit(most) * F.col("source_size"))), F.lit(0.0)).alias("cut"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("free")).first()
        if some["n"] <= held or not some["free"]:
            return unit
        held, unit = some["n"], (budget - some["cut"]) / some["free"]


def plan_sources(rows: DataFrame, weights=WEIGHTS, factor: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n_rows, sid, weight, target of each source, as a table. rows: as measured() gives them."""
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    sources = staged(_numbered(found).withColumn("weight", F.get(cycle, F.pmod("sid", F.lit(len(weights))).cast("int"))), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    unit = _unit(sources, factor * total, most)
    return staged(sources.withColumn("target", F.least(F.lit(most) * F.col("source_size"), F.col("weight") * unit)), "mix-plan")


def _scheduled(plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plan with each source's points, blocks and stretches; and (sid, slot, rank) of each slot that a source takes."""
    spark = plan.sparkSession
    taken = plan.withColumn("_take", F.rint("target").cast("long"))
    before, at = [], 0
    for r in taken.groupBy("_p").agg(F.sum("_take").alias("n")).orderBy("_p").collect():
        before.append((r["_p"], at))
        at += r["n"]
    bits = max(SLOTS.bit_length() - 1, math.ceil(math.log2(max(1, at / BLOCK))))
    slots = 1 << bits
    offsets = F.broadcast(spark.createDataFrame(before, "_p int, _before long"))
    along = Window.partitionBy("_p").orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    done = taken.join(offsets, "_p").withColumn("_done", F.col("_before") + F.sum("_take").over(along))
    # Points from first up to end are the source's; one too small for any shares the point that it starts at.
    edge = lambda x: F.expr(f"cast((cast({x} as decimal(38,0)) * {slots} + {max(1, at) - 1}) div {max(1, at)} as bigint)")
    facts = done.withColumn("_first", edge("(_done - _take)")).withColumn("_end", edge("_done")).withColumn("_own", F.greatest(F.col("_end") - F.col("_first"), F.lit(0)))
    facts = facts.withColumn("_slots", F.when(F.col("_take") > 0, F.greatest("_own", F.lit(1))).otherwise(0))
    facts = facts.withColumn("_block", F.expr("if(_slots > 0, (_take + _slots - 1) div _slots, 1)")).withColumn("_stretches", F.expr(f"greatest(1, (n_rows + {STRETCH} - 1) div {STRETCH})"))
    facts = staged(facts.select("sid", F.col("source").alias("_name"), "source_size", "_take", "_first", "_slots", "_block", "_stretches"), "mix-schedule")
    # A source's points a stretch at a time, dealt to tasks before each is written out.
    some = facts.filter("_slots > 0").select("sid", F.col("_first").alias("a"), (F.col("_first") + F.col("_slots")).alias("b"))
    some = some.select("sid", "b", F.explode(F.expr(f"sequence(a, b - 1, {TIME}L)")).alias("a")).repartition("sid", "a")
    points = some.select("sid", F.explode(F.expr(f"sequence(a, least(b, a + {TIME}L) - 1)")).alias("point")).withColumn("point", F.least("point", F.lit(slots - 1)))
    slot = F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("long")
    # Ranks of a source's slots in two steps, by stretch of time and within it, so that no source is one task's.
    scheduled = points.withColumn("slot", slot).withColumn("_t", F.floor(F.col("slot") / TIME))
    counts = scheduled.groupBy("sid", "_t").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy("sid").orderBy("_t")
    counts = counts.withColumn("_base", F.sum("_c").over(upto) - F.col("_c")).drop("_c")
    # Slots are as many as blocks of words, but come of a table of a few sources, by which Spark would think them few.
    ranked = scheduled.join(counts.hint("merge"), ["sid", "_t"]).withColumn("rank", F.col("_base") + F.row_number().over(Window.partitionBy("sid", "_t").orderBy("slot", "point")) - 1)
    return facts, ranked.select("sid", "slot", "rank")


def mix(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """slot, sid, source, doc_id, text_hash, copy, epoch, start, length: the pieces of documents in the order of slots.

    rows: as measured() gives them; plan: as plan_sources() does. start and length are in words of the document.
    """
    facts, scheduled = _scheduled(plan)
    # Sources are a table of their own, so Spark broadcasts them while they are few and splits a hot one's rows else.
    named = rows.filter("size > 0").join(facts.filter("_slots > 0"), F.col("source").eqNullSafe(F.col("_name"))).drop("_name", "_first", "_slots")
    shuffled = named.withColumn("_u", F.xxhash64("doc_id", "text_hash", "copy", F.lit(29)))
    shuffled = shuffled.withColumn("_s", F.pmod(F.shiftright("_u", 20), F.col("_stretches")))
    sums = shuffled.groupBy("sid", "_s").agg(F.sum("size").alias("_c"))
    sums = sums.withColumn("_before", F.sum("_c").over(Window.partitionBy("sid").orderBy("_s")) - F.col("_c")).drop("_c")
    along = Window.partitionBy("sid", "_s").orderBy("_u", "doc_id", "text_hash", "copy").rowsBetween(Window.unboundedPreceding, 0)
    stream = shuffled.withColumn("_upto", F.sum("size").over(along)).join(sums, ["sid", "_s"]).withColumn("_at", F.col("_before") + F.col("_upto") - F.col("size"))
    # Where each reading of a document stands in its source's stream, cut at what the source gives in all.
    read = stream.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("greatest(0, (_take - 1) div source_size)"))))
    read = read.withColumn("_lo", F.col("_at") + F.col("epoch") * F.col("source_size")).withColumn("_hi", F.least(F.col("_lo") + F.col("size"), F.col("_take"))).filter("_lo < _hi")
    cut = read.withColumn("rank", F.explode(F.expr("sequence(_lo div _block, (_hi - 1) div _block)")))
    begin, end = F.greatest("_lo", F.col("rank") * F.col("_block")), F.least("_hi", (F.col("rank") + 1) * F.col("_block"))
    cut = cut.select("sid", "rank", "source", "doc_id", "text_hash", "copy", "epoch", (begin - F.col("_lo")).alias("start"), (end - begin).alias("length"))
    return cut.join(scheduled.hint("merge"), ["sid", "rank"]).select("slot", "sid", "source", "doc_id", "text_hash", "copy", "epoch", "start", "length")


def taken(docs: DataFrame, weights=WEIGHTS, factor: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot, n_slots of every document: how many of its words the schedule
    takes, repeats counted, in which slot first, and in how many."""
    rows = staged(measured(docs), "mix-sizes")
    plan = plan_sources(rows, weights, factor, most)
    key = ["doc_id", "source", "text_hash", "copy"]
    got = mix(rows, plan).groupBy(*key).agg(F.sum("length").alias("_taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
    got = got.select(*(F.col(k).alias(f"_{k}") for k in key), "_taken", "first_slot", "n_slots")
    facts = plan.select(F.col("source").alias("_name"), "source_size", "target")
    out = rows.join(got, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left").join(facts, F.col("source").eqNullSafe(F.col("_name")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).alias("n_slots"))

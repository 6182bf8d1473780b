"""The latest row of each key, kept as a stream brings more: a pointer to one generation of parts at a time.

A batch adds one part, with the last row of each of its keys; a generation is what a version names (see ``versions``). When
there are MOST parts they are put together to one, and rows that are too old are left out. A batch that comes again after
a failure is known by its number and adds nothing. Readers take a generation and stay with it while others are made.
"""

from __future__ import annotations

import time
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import versions
from ..operators import reports
from ..storage import shared_dir

#: Parts of a generation after which the next is one part.
MOST = 8
ORDER = ("completed_at", "review_key")


def generation(spark: SparkSession, path: str, keys: tuple[str, ...], order: tuple[str, ...] = ORDER, version: versions.Version | None = None) -> DataFrame | None:
    """The latest row of each key in a generation, the last if none is given; null before the first."""
    v = version or versions.current(spark, path)
    if not v.parts:
        return None
    rows = spark.read.parquet(*(versions.part_path(path, p) for p in v.parts))
    return rows if len(v.parts) == 1 else reports.latest(rows, *keys, order=order)


def upsert(batch: DataFrame, path: str, keys: tuple[str, ...], order: tuple[str, ...] = ORDER, number: int | None = None, alive: Column | None = None) -> versions.Version:
    """Add a batch's rows. number: the batch's, which grows; one that is in already is passed over. alive: which rows a
    generation that is put together keeps (such as those younger than some age)."""
    spark = batch.sparkSession
    while True:
        seen = versions.current(spark, path)
        last = seen.facts.get("batch", -1)
        if number is not None and last >= number:
            return seen
        part = versions.new_part()
        fresh = reports.latest(batch, *keys, order=order)
        parts = seen.parts | {part: {}}
        if len(parts) > MOST:
            old = spark.read.schema(fresh.schema).parquet(*(versions.part_path(path, p) for p in seen.parts))
            fresh, parts = reports.latest(old.unionByName(fresh), *keys, order=order), {part: {}}
            if alive is not None:
                fresh = fresh.filter(alive)
        fresh.write.parquet(versions.part_path(path, part))
        try:
            return versions.publish(spark, path, seen, parts, batch=last if number is None else number)
        except versions.Lost:
            versions.drop(spark, path, part)


def keep_latest(stream: DataFrame, path: str, keys: tuple[str, ...], order: tuple[str, ...] = ORDER, alive: Column | None = None, **trigger):
    """Start keeping the latest rows of a stream; all that is there now, if no other trigger is given."""

    def put(batch: DataFrame, number: int) -> None:
        upsert(batch, path, keys, order, number, alive)

    spot = f"{shared_dir(stream.sparkSession)}/latest-checkpoint-{crc32(path.encode())}"
    return stream.writeStream.option("checkpointLocation", spot).trigger(**(trigger or {"availableNow": True})).foreachBatch(put).start()


class Refreshed:
    """A reader's view of the index: one generation, looked up anew when it is older than so many seconds."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], order: tuple[str, ...] = ORDER, seconds: float = 30.0, clock=time.monotonic):
        self.spark, self.path, self.keys, self.order, self.seconds, self.clock = spark, path, keys, order, seconds, clock
        self.version, self.at = None, None

    def get(self) -> DataFrame | None:
        if self.at is None or self.clock() - self.at >= self.seconds:
            self.refresh()
        return generation(self.spark, self.path, self.keys, self.order, self.version) if self.version.parts else None

    def refresh(self) -> None:
        self.version, self.at = versions.current(self.spark, self.path), self.clock()


def by_subject(pairs: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """submission_id and its reports, last first: the list that a reader of one submission is given. A submission has as
    many as there are others that it was held against."""
    row = F.struct(*order, *(c for c in pairs.columns if c not in (*order, "submission_id")))
    return pairs.groupBy("submission_id").agg(F.sort_array(F.collect_list(row), asc=False).alias("reports"))

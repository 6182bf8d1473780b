"""An index of the corpus for one target at a time: what a new submission is like, without reading the corpus.

The corpus is written once, and added to, as parts of four tables, each in buckets of a hash of what it is looked up by:

* ``sets``: the entities with the hashes of their sets, to hold a candidate against. They are written where they were made,
  some hundred together to a ``place``, and looked up by that: a hash takes more bytes than its text, so hashes are
  written once and not shuffled.
* ``postings``: the rarest hashes of each set of a lab. A set of n that shares t of its hashes with another shares one of
  any n - ceil(t * n) + 1 of them, so these few per set are enough, whichever are taken; they are the ones that are rare
  by the counts of ``SLOTS`` classes of hashes, so that a common passage of all submissions is hardly ever posted. A row is
  two numbers of 40 bits, for lab and hash and for lab and set; where they meet by chance there is one candidate more.
* ``members``: who has a set, and the place where it is. ``digests``: members by input digest and by delta digest.

A probe reads the target's hashes' buckets of the postings, then the members that these name and the place of one member of
each set, and two buckets of the digests. Which buckets those are is told by the target alone, and how large a bucket is
by ``ROWS``, so what is read does not grow with the corpus unless matches do. Parts are named by versions (see
``versions``): a probe sees all of an addition or nothing, and a repeated addition (by its name) is done once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import versions
from ..storage import staged
from . import similarity

#: Postings in a bucket, about: a part has as many buckets as that takes, a power of two, and at most MOST_BUCKETS.
ROWS, MOST_BUCKETS = 1 << 16, 1 << 14
#: Entities of a place; classes of hashes that are counted (a broadcast of 2 MB, whatever the corpus).
TOGETHER, SLOTS = 256, 1 << 18
MEMBER = ("lab_id", "set_id", "n", "id", "owner", "submitted_at", "input_digest", "delta_digest", "incomplete", "changed_files")


def _bucket(buckets: int, *of) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(buckets)).cast("int")


def _number(*of) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(1 << 40))


def _save(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy("bucket").option("compression", "zstd").parquet(path)


def _write(rows: DataFrame, path: str, buckets: int, of: list[str]) -> None:
    """A folder a bucket; Spark splits the bucket of a digest or set that very many members have, and puts small ones together."""
    _save(rows.withColumn("bucket", _bucket(buckets, *of)).hint("rebalance", "bucket").sortWithinPartitions("bucket", *of), path)


def _counts(sets: DataFrame) -> np.ndarray:
    """How many hashes each class has: as many numbers as there are classes, however many hashes."""
    out = np.zeros(SLOTS, np.int64)
    for slot, n in sets.select(F.explode("hashes").alias("h")).groupBy(F.pmod("h", F.lit(SLOTS)).alias("s")).count().collect():
        out[slot] = n
    return out


def _enough(threshold: float) -> Column:
    """Hashes of a set of n that no similar set can do without all of."""
    return F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1


def _rarest(sets: DataFrame, threshold: float) -> DataFrame:
    """p, s: numbers of lab and hash, lab and set, for as many of each set's rarest hashes as are enough."""
    counts = sets.sparkSession.sparkContext.broadcast(_counts(sets))

    @F.pandas_udf("array<bigint>")
    def rare(hashes: pd.Series, most: pd.Series) -> pd.Series:
        often = counts.value
        return pd.Series([x[np.argpartition(often[x % SLOTS], m - 1)[:m]] for x, m in zip(hashes, most)], dtype=object)

    each = sets.filter("n > 0").select("lab_id", "set_id", F.explode(rare("hashes", _enough(threshold).cast("int"))).alias("h"))
    return each.select(_number("lab_id", "h").alias("p"), _number("lab_id", "set_id").alias("s"))


def _digests(members: DataFrame, *columns: str) -> DataFrame:
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_digest").alias("digest")) for k in ("input", "delta")))
    return members.withColumn("_d", F.explode(kinds)).select("_d.*", *columns)


def add(entities: DataFrame, path: str, name: str, threshold: float = similarity.THRESHOLD, buckets: int | None = None) -> versions.Version:
    """Add entities (see ``similarity``) to the index. An addition of a name that is in it already does nothing, so that a
    job that is run again adds once; the threshold is the least that probes may ask for. Additions do not shut each other out."""
    spark = entities.sparkSession
    seen = versions.current(spark, path)
    if any(note["name"] == name for note in seen.parts.values()):
        return seen
    part = versions.new_part()
    where = versions.part_path(path, part)
    place = F.xxhash64(F.lit(part), F.floor(F.monotonically_increasing_id() / TOGETHER))
    made = similarity.hash_sets(entities).select(*MEMBER, "hashes", place.alias("place")).withColumn("bucket", _bucket(MOST_BUCKETS, "place"))
    _save(made, f"{where}/sets")
    sets = spark.read.schema(made.schema).parquet(f"{where}/sets")
    members = sets.select(*MEMBER, "place", _number("lab_id", "set_id").alias("s"))
    if buckets is None:
        posted = sets.filter("n > 0").agg(F.sum(_enough(threshold))).first()[0] or 0
        buckets = min(MOST_BUCKETS, 1 << (posted // ROWS).bit_length())
    # A bucket is one task's, which drops what copies of a set post again.
    postings = _rarest(sets, threshold).withColumn("bucket", _bucket(buckets, "p")).repartition("bucket").dropDuplicates(["bucket", "p", "s"])
    _save(postings.sortWithinPartitions("bucket", "p"), f"{where}/postings")
    _write(members, f"{where}/members", buckets, ["s"])
    _write(_digests(members, *MEMBER, "place").filter("digest is not null"), f"{where}/digests", buckets, ["lab_id", "kind", "digest"])
    while True:
        try:
            return versions.publish(spark, path, seen, seen.parts | {part: {"name": name, "buckets": buckets, "places": MOST_BUCKETS, "threshold": threshold}})
        except versions.Lost:
            seen = versions.current(spark, path)
            if any(note["name"] == name for note in seen.parts.values()):
                versions.drop(spark, path, part)
                return seen


def _schema(t: DataFrame, table: str):
    """Of a table of the index, by a hashed entity's."""
    number = lambda c: F.lit(0).cast("long").alias(c)
    own = {"postings": [number("p"), number("s")], "sets": [*MEMBER, "hashes", number("place")], "members": [*MEMBER, number("place"), number("s")], "digests": [F.lit("").alias("kind"), F.lit("").alias("digest"), *MEMBER, number("place")]}
    return t.select(*own[table], F.lit(0).alias("bucket")).schema


def _lookup(t: DataFrame, path: str, v: versions.Version, table: str, keys: DataFrame, *of: str) -> DataFrame | None:
    """The rows of a table under the keys (a column for each of `of`). The keys' buckets, of which there are a fixed number
    at most, pick the folders; within them the keys are joined."""
    found = None
    for part, note in v.parts.items():
        wanted = [r[0] for r in keys.select(_bucket(note["places" if table == "sets" else "buckets"], *of)).distinct().collect()]
        if not wanted:
            continue
        rows = t.sparkSession.read.schema(_schema(t, table)).parquet(f"{versions.part_path(path, part)}/{table}").filter(F.col("bucket").isin(wanted)).drop("bucket")
        found = rows if found is None else found.unionByName(rows)
    return None if found is None else found.join(keys.select(*of).distinct(), list(of), "left_semi")


def probe(path: str, target: DataFrame, threshold: float = similarity.THRESHOLD) -> DataFrame:
    """The pairs of one target (a row of entities) with the indexed corpus: the same rows as ``similarity.target_against``."""
    spark = target.sparkSession
    v = versions.current(spark, path)
    if any(note["threshold"] > threshold for note in v.parts.values()):
        raise ValueError("the index was made for a higher threshold")
    t = similarity.hashed(target)
    if t.count() != 1:
        raise ValueError("one target is probed at a time")
    place = F.lit(0).cast("long").alias("place")
    members = t.select(*MEMBER, place).limit(0)
    near = t.filter("n > 0 and not incomplete").select("lab_id", F.explode("hashes").alias("h")).select(_number("lab_id", "h").alias("p"))
    same = _lookup(t, path, v, "digests", _digests(t, "lab_id"), "lab_id", "kind", "digest")
    if same is not None:
        members = members.unionByName(same.select(*members.columns))
    posted = _lookup(t, path, v, "postings", near, "p")
    if posted is not None:
        likely = staged(posted.select("s").distinct(), "index-likely")
        own = _lookup(t, path, v, "members", likely, "s")
        if own is not None:
            size = t.select("lab_id", F.col("n").alias("_m"))
            fit = F.least("n", "_m") >= threshold * F.greatest("n", "_m") - 1e-9
            members = members.unionByName(own.join(F.broadcast(size), "lab_id").filter(fit).select(*members.columns))  # size is one row
    members = staged(members.dropDuplicates(["lab_id", "id"]), "index-members")
    # Of a set's members one is read with its hashes.
    one = members.filter("n > 0").groupBy("lab_id", "set_id").agg(F.min(F.struct("place", "id")).alias("_o")).select("lab_id", "set_id", "_o.*")
    sets = _lookup(t, path, v, "sets", one, "place")
    if sets is None:
        sets = t.select("lab_id", "set_id", "id", "hashes", place).limit(0)
    sets = sets.join(one, ["lab_id", "set_id", "id", "place"], "left_semi").dropDuplicates(["lab_id", "set_id"])
    met = members.join(sets.select("lab_id", "set_id", "hashes"), ["lab_id", "set_id"], "left")
    met = met.withColumn("hashes", F.coalesce("hashes", F.array().cast("array<bigint>")))
    return similarity.against_target(met, t, "hashes", threshold)

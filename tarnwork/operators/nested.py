"""Values nested to any depth in JSON: each with its path, and what any of them says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import staged

# What says that evidence was cut.
FLAGS, COUNTS = ("truncated", "input_truncated"), ("omitted_file_count",)


def entries(rows: DataFrame, value: str, *key: str) -> DataFrame:
    """key.., path, name, depth, value (a variant) of every member of objects and element of lists under a variant column.

    A level at a time, each a table in the shared folder: there are as many rounds as the data is deep, and what a round
    reads is what the last one found nested. A value without members, or a null, has no rows."""
    spark = rows.sparkSession
    names = [*key, "path", "name", "depth", "value"]
    level = rows.select(*key, F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("depth"), F.col(value).alias("value"))
    found = None
    while True:
        kind = F.schema_of_variant("value")
        inner = level.filter(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        made = spark.sql("SELECT l.*, e.pos AS _pos, e.key AS _key, e.value AS _value FROM {level} l, LATERAL variant_explode(l.value) e", level=inner)
        path = F.when(F.col("_key").isNotNull(), F.concat_ws(".", "path", "_key")).otherwise(F.concat("path", F.lit("["), F.col("_pos"), F.lit("]")))
        level = staged(made.select(*key, path.alias("path"), F.col("_key").alias("name"), (F.col("depth") + 1).alias("depth"), F.col("_value").alias("value")), "nested")
        if found is not None and level.isEmpty():
            return found.select(*names)
        found = level if found is None else found.unionByName(level)


def truncated(rows: DataFrame, value: str, *key: str, flags: tuple[str, ...] = FLAGS, counts: tuple[str, ...] = COUNTS) -> DataFrame:
    """key.., truncated: whether anything in the value, however deep, is marked as cut by a flag that is true or by a count
    over nothing. Of rows with one key, any."""
    kind, v = F.schema_of_variant("value"), F.col("value")
    flag = F.col("name").isin(*flags) & (kind == "BOOLEAN") & F.try_variant_get(v, "$", "boolean")
    whole = F.when(kind.startswith("BIGINT") | kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double") > 0).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
    said = entries(rows, value, *key).filter(F.coalesce(flag | (F.col("name").isin(*counts) & whole), F.lit(False)))
    marks = said.select(*key).distinct().withColumn("truncated", F.lit(True))
    return rows.select(*key).distinct().join(marks, list(key), "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))

"""What the operators share: staged tables (the library's), free column names, word splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import adopt, discard, opened, release, shared_dir, staged  # noqa: F401

#: Words of the whitespace-word operators: runs of anything but these six ASCII characters.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Copies of a row that one array names, so that a row of very many copies needs no long one.
COPIES = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to be no column of df's."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    """All columns by name, whatever signs the names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def words_of(text: Column) -> Column:
    """The whitespace words of a text, in order; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def each_copy(df: DataFrame, n: str, name: str) -> DataFrame:
    """A row for each of a row's n copies, numbered from 0; n goes."""
    part, count = free(df, "_part")[0], F.col(n)
    some = df.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / COPIES))))
    first = F.col(part) * COPIES
    return some.withColumn(name, F.explode(F.sequence(first, F.least(count - 1, first + COPIES - 1)))).drop(part, *([n] if n != name else []))

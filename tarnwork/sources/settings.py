"""Settings from the environment or the session's configuration."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    minimum_score: int = 60
    threshold: float = 0.7
    shingle_size: int = 5
    permutations: int = 64
    band_size: int = 4
    file_bytes: int = 10 << 20
    total_bytes: int = 10 << 20
    evidence_chars: int = 240_000


def load(spark: SparkSession | None = None, prefix: str = "AUDIT_") -> Settings:
    """spark.audit.<name>, else <prefix><NAME>, else the default."""
    given = {}
    for f in fields(Settings):
        value = (spark.conf.get(f"spark.audit.{f.name}", None) if spark else None) or os.environ.get(prefix + f.name.upper())
        if value is not None:
            given[f.name] = type(f.default)(value)
    return Settings(**given)

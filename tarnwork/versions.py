"""Tables of parts under a folder, with a pointer that only one writer at a time can move.

A version is a small file that names the parts which hold, and facts about them. Writers put new parts beside the old
ones, where no reader looks, and then claim the next version's number: the claim is a link or a rename onto a name that
must not be there, so of two writers that saw the same version one is told that it lost, and looks again. Readers take
the last version and see all of its parts or none. Nothing is changed in place; parts that no kept version names go by
expire(). The file system must refuse a rename onto a file that is there (HDFS does); local ones are linked.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .storage import file_system


class Lost(RuntimeError):
    """Another writer made the version that was to follow."""


@dataclass(frozen=True)
class Version:
    number: int = -1
    #: Each part's name, with what its writer noted of it.
    parts: dict = field(default_factory=dict)
    facts: dict = field(default_factory=dict)


def _names(spark: SparkSession, folder: str) -> list[int]:
    files, where = file_system(spark, f"{folder}/versions")
    if not files.exists(where):
        return []
    return sorted(int(n) for s in files.listStatus(where) if (n := s.getPath().getName().removesuffix(".json")).isdigit())


def read(spark: SparkSession, folder: str, number: int) -> Version:
    files, where = file_system(spark, f"{folder}/versions/{number:012d}.json")
    stream = files.open(where)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Version(number, **json.loads(text))


def current(spark: SparkSession, folder: str) -> Version:
    """The last version; number -1 and no parts if there is none."""
    known = _names(spark, folder)
    return read(spark, folder, known[-1]) if known else Version()


def part_path(folder: str, part: str) -> str:
    return f"{folder}/parts/{part}"


def new_part() -> str:
    return uuid.uuid4().hex


def drop(spark: SparkSession, folder: str, *parts: str) -> None:
    """Delete parts that no version names."""
    for part in parts:
        files, where = file_system(spark, part_path(folder, part))
        files.delete(where, True)


def publish(spark: SparkSession, folder: str, after: Version, parts: dict, **facts) -> Version:
    """The version after the one seen; Lost if another writer was first."""
    new = Version(after.number + 1, parts, facts)
    name, body = f"{folder}/versions/{new.number:012d}.json", json.dumps({"parts": parts, "facts": facts})
    files, where = file_system(spark, name)
    _, spare = file_system(spark, f"{folder}/versions/.{uuid.uuid4().hex}")
    stream = files.create(spare, False)
    try:
        stream.write(bytearray(body.encode()))
    finally:
        stream.close()
    try:
        if files.getScheme() == "file":
            path = lambda p: p.toUri().getPath()
            try:
                os.link(path(spare), path(where))
            except FileExistsError:
                raise Lost(name) from None
        elif files.exists(where) or not files.rename(spare, where):
            raise Lost(name)
    finally:
        files.delete(spare, False)
    return new


def expire(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Delete the parts that only versions before the last `keep` name; returns their names. Versions stay, so that their
    numbers cannot be claimed again; what readers and writers of kept versions use stays too. Parts of a writer that is
    still at work are in no version and are left alone."""
    known = _names(spark, folder)
    live = {p for n in known[-keep:] for p in read(spark, folder, n).parts}
    gone = sorted({p for n in known[:-keep] for p in read(spark, folder, n).parts} - live)
    drop(spark, folder, *gone)
    return gone

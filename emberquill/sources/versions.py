"""Versioned tables: every version is a folder, a pointer file names the one that counts.

Readers that hold a version see it whole whatever is published later.  Publishing compares the
version it was built on with the current one and fails if another writer was first.  All of it goes
through Hadoop's file systems, so a root may lie on any storage that all machines share.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import Generic, TypeVar

from pyspark.sql import DataFrame, SparkSession

V = TypeVar("V")
#: Seconds after which a pointer that still names nothing belongs to a dead writer.
DEAD = 600


class Conflict(RuntimeError):
    """Another version has been published in between."""


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _pointers(spark: SparkSession, root: str) -> dict[int, str]:
    """The folder of every published version; a pointer without a name belongs to a writer that died over it and counts for nothing."""
    fs, path = _fs(spark, root)
    out = {}
    for s in fs.listStatus(path(root)) if fs.exists(path(root)) else ():
        name = s.getPath().getName()
        if name.startswith("p") and name[1:].isdigit() and s.getLen() > 0:
            stream = fs.open(s.getPath())
            try:
                out[int(name[1:])] = stream.readUTF()
            finally:
                stream.close()
    return out


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions, oldest first."""
    return sorted(_pointers(spark, root))


def current(spark: SparkSession, root: str) -> int:
    """The current version; 0 before the first."""
    return max(_pointers(spark, root), default=0)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The current or a given version."""
    known = _pointers(spark, root)
    version = max(known, default=0) if version is None else version
    if version not in known:
        raise FileNotFoundError(f"no version {version} in {root}")
    return spark.read.parquet(f"{root}/{known[version]}")


def publish(df: DataFrame, root: str, expected: int) -> int:
    """Writes ``df`` as the version after ``expected``; raises Conflict if that isn't the current one.

    The table is complete, in a folder of its own, before the pointer to it is made: an exclusive
    create, so of two writers one wins.  A writer that dies leaves at most a folder that nothing
    names, or an empty pointer, which a later writer replaces once it is DEAD seconds old.
    """
    spark = df.sparkSession
    if (now := current(spark, root)) != expected:
        raise Conflict(f"built on {expected}, current is {now}")
    fs, path = _fs(spark, root)
    number, folder = expected + 1, f"v{expected + 1}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    pointer = path(f"{root}/p{number}")
    try:
        if fs.exists(pointer) and (s := fs.getFileStatus(pointer)).getLen() == 0 and time.time() * 1000 - s.getModificationTime() > 1000 * DEAD:
            fs.delete(pointer, False)
        if fs.exists(pointer):
            raise Conflict(f"version {number} has been or is being published")
        try:
            claimed = fs.create(pointer, False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"version {number} has been or is being published") from None
            raise
    except Exception:
        fs.delete(path(f"{root}/{folder}"), True)
        raise
    claimed.writeUTF(folder)
    claimed.close()
    return number


def initialise(df: DataFrame, root: str) -> int:
    """The first version; raises Conflict if there is one."""
    return publish(df, root, 0)


def dry_run(merged: DataFrame) -> dict[str, int]:
    """What a merge would do: rows by action.  Nothing is written."""
    return {r["action"]: r["count"] for r in merged.groupBy("action").count().collect()}


class Cached(Generic[V]):
    """A value derived from a published state, kept as long as the state's revision and hash stay the same.

    ``state`` gives (revision, hash) and is asked every time; ``load`` makes the value.  If either fails
    and there is a value, that one is given: it is stale, and ``stale`` says so.
    """

    def __init__(self, state: Callable[[], tuple[int, str]], load: Callable[[], V]) -> None:
        self._state, self._load = state, load
        self._key: tuple[int, str] | None = None
        self._value: V | None = None
        self.stale = False

    def get(self) -> V:
        try:
            key = tuple(self._state())
            if key != self._key:
                self._value, self._key = self._load(), key
            self.stale = False
        except Exception:
            if self._key is None:
                raise
            self.stale = True
        return self._value

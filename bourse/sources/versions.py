"""Published states of a folder: readers see the old state or the new one, never a mixture.

A writer puts new files beside the old ones and then publishes a small JSON
state that names them, by renaming a finished file to the next number. The
rename is one step of the file system and fails when the number is taken,
so of two writers one wins and the other one's files are never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

_PREFIX, _SUFFIX = "_state-", ".json"


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _child(spark: SparkSession, folder: str, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")


def published(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """(number, state) of the folder; (0, None) before the first."""
    fs, path = _fs(spark, folder)
    if not fs.exists(path):
        return 0, None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    numbers = [int(n[len(_PREFIX):-len(_SUFFIX)]) for n in names if n.startswith(_PREFIX) and n.endswith(_SUFFIX)]
    if not numbers:
        return 0, None
    stream = fs.open(_child(spark, folder, f"{_PREFIX}{max(numbers):012d}{_SUFFIX}"))
    try:
        return max(numbers), json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, folder: str, state: dict, after: int) -> int:
    """Make ``state`` the one that follows number ``after``; an error if another writer was first."""
    fs, path = _fs(spark, folder)
    fs.mkdirs(path)
    made = _child(spark, folder, f"_new-{uuid.uuid4().hex}")
    out = fs.create(made)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    if fs.exists(_child(spark, folder, f"{_PREFIX}{after + 1:012d}{_SUFFIX}")) or not fs.rename(
            made, _child(spark, folder, f"{_PREFIX}{after + 1:012d}{_SUFFIX}")):
        fs.delete(made, False)
        raise RuntimeError(f"another writer has published state {after + 1} of {folder}")
    return after + 1


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders that no published state names any more."""
    for p in paths:
        fs, path = _fs(spark, p)
        fs.delete(path, True)

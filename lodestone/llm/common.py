"""Shared folders, written tables, and files that executors write there."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..shared import shared_dir

#: Paths that this process has handed out and not removed.
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, with a scheme so that any file system library can open it."""
    base = shared_dir(spark)
    _made.append(f"{base if '://' in base else 'file://' + os.path.abspath(base)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """How many paths there are that were handed out and not removed."""
    return len(_made)


def remove_made(spark: SparkSession, first: int, keep: int = 0) -> None:
    """Remove what was made since :func:`made` said ``first``, but the last ``keep``; for a caller that has written its result."""
    jvm = spark.sparkContext._jvm
    gone = _made[first : len(_made) - keep]
    del _made[first : len(_made) - keep]
    for path in gone:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores as set it apart from the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: cuts lineage, and survives the loss of any executor."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI; also on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, parts: Iterable[bytes]) -> None:
    """Write a file under a name of its own, then move it in place, so that a repeated or speculative task leaves one whole file."""
    filesystem, path = file_system(uri)
    folder, _, name = path.rpartition("/")
    filesystem.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with filesystem.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
    filesystem.move(temporary, path)


def batched(rows: Iterable, size: int) -> Iterator[list]:
    """Lists of ``size`` items at most."""
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held

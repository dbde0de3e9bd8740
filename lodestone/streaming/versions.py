"""File versions as a stream: new ones are appended as commits come in, late repeats are dropped."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..sources.store import Store


def read(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """File versions from Parquet files that arrive in a folder."""
    return spark.readStream.schema(schemas.FILE_VERSIONS).option("maxFilesPerTrigger", files).parquet(folder)


def unique(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each version once, if its repeats come within ``late``; the state of older ones is let go."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["repo_id", "file_path", "hash", "commit_hash"])


def activity(stream: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, repo_id, versions, files) of each window of event time."""
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", window), "repo_id").agg(F.count("*").alias("versions"), F.approx_count_distinct("file_path").alias("files"))
    return counted.select(F.col("window.start").alias("start"), "repo_id", "versions", "files")


LINEAGE = f"{schemas.FILE_VERSIONS}, previous_hash string, change string"
_STATE = "hash string, at long"


def lineage(stream: DataFrame, late: str = "1 hour", keep: int = 365) -> DataFrame:
    """Versions with ``previous_hash`` and ``change`` as they come: ``first`` of a file, ``changed``, ``same``, or ``late``.

    Each file's state is its last version. Rows of a batch go by ts, then hash. A row older than what its file has already is
    late: it has no previous hash, and changes nothing. A file without a version for ``keep`` days of event time is let go, and
    its next version is a first one again.
    """

    def follow(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "hash"], kind="stable")
        last, at = state.get if state.exists else (None, None)
        before, change = [], []
        for own, moment in zip(rows["hash"], rows["ts"].astype("datetime64[us]").astype("int64"), strict=True):
            if at is not None and moment < at:
                before.append(None)
                change.append("late")
                continue
            before.append(last)
            change.append("first" if at is None else "same" if own == last else "changed")
            last, at = own, int(moment)
        state.update((last, at))
        state.setTimeoutTimestamp(max(at // 1000 + keep * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(previous_hash=pd.array(before, dtype=object), change=change)[[f.split()[0] for f in LINEAGE.split(", ")]]

    kept = stream.withWatermark("ts", late).select([f.split()[0] for f in schemas.FILE_VERSIONS.split(", ")])
    return kept.groupBy("repo_id", "file_path").applyInPandasWithState(follow, LINEAGE, _STATE, "append", "EventTimeTimeout")


def follow(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write the lineage of versions to a folder of Parquet, each row once, also after a restart."""
    return lineage(stream).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def track(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Append versions that the store doesn't have. A batch that runs again adds nothing, as its rows are there already."""

    def batch(rows: DataFrame, _: int) -> None:
        rows.persist()  # a batch with state must not be computed twice
        store.append_new("file_versions", rows)
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

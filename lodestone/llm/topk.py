"""Exact top-k search by distributed histogram selection.

Every candidate is scored against a broadcast block of queries. Global score
histograms, summed in Spark, are refined until the bin that holds each query's
k-th value is narrow; a last pass keeps the rows at or above that bin, and ties
go to the smaller id. Rows are never dropped by approximation: what a task
leaves out is below k better rows of its own.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part; vectors of another dimension than a query's are no
candidates of it; rows with the query's own id are none either. Several query
rows with one id count once, by their smallest vector. Candidates with one id
are separate rows. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, new_path

#: Queries in a broadcast block; bounds a block to BLOCK x dimension doubles.
BLOCK = 1024
#: Histogram bins of a query in one pass, and the most passes of refinement.
BINS, PASSES = 512, 3
#: Candidates scored at once in a task.
ROWS = 2048


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>) of the rows that take part."""
    v = F.col("__v")
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("__v"))
        .filter(F.col("id").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .withColumnRenamed("__v", "vec")
    )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of rows of one dimension, ROWS at most."""
    for batch in batches:
        ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        starts, size = ends[:-1] - ends[0], np.diff(ends)
        for d in np.unique(size):
            (at,) = np.nonzero(size == d)
            for i in range(0, len(at), ROWS):
                own = at[i : i + ROWS]
                yield ids[own], flat[starts[own][:, None] + np.arange(d)]


def _scores(batches, block):
    """(query positions, ids, scores: rows x queries) against the queries of each dimension; a query's own id scores -inf."""
    for ids, x in _groups(batches):
        if x.shape[1] in block:
            at, own, q = block[x.shape[1]]
            s = x @ q.T
            s[ids[:, None] == own[None, :]] = -np.inf
            yield at, ids, s


def exact_topk(candidates: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score double): the k highest inner products of each query among ``candidates``.

    ``queries`` pass the driver in blocks of ``block_rows``, each block's result being written before the next is read.
    """
    spark = candidates.sparkSession
    rows = usable(candidates, id_col, vec_col)
    asked = usable(queries, id_col, vec_col).groupBy("id").agg(F.min("vec").alias("vec"))
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    longest = rows.agg(F.max(F.sqrt(square))).first()[0] or 0.0
    path = new_path(spark, "topk")
    schema = "query_id long, rank int, id long, score double"
    for held in batched(asked.toLocalIterator(), block_rows):
        found, sent = _block(rows, held, longest, k)
        found.write.mode("append").parquet(path)
        for x in sent:
            x.destroy()
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _block(rows: DataFrame, held: list, longest: float, k: int) -> tuple[DataFrame, list]:
    """The block's result, and the broadcasts that it needs until it is written."""
    spark = rows.sparkSession
    ids = np.array([r["id"] for r in held], dtype=np.int64)
    dims: dict[int, list[int]] = {}
    for i, r in enumerate(held):
        dims.setdefault(len(r["vec"]), []).append(i)
    block = {d: (np.array(at), ids[at], np.array([held[i]["vec"] for i in at], dtype=np.float64)) for d, at in dims.items()}
    reach = np.zeros(len(held))
    for at, _, q in block.values():
        reach[at] = np.sqrt((q * q).sum(axis=1)) * longest * (1 + 1e-9) + 1e-9
    # Each query's k-th value lies in [low, low + width * BINS); `need` rows of it are still to be found there.
    low, width, need = -reach, 2 * reach / BINS, np.full(len(held), k)
    shared = spark.sparkContext.broadcast(block)
    for _ in range(PASSES):
        now = spark.sparkContext.broadcast((low.copy(), width.copy(), need.copy()))
        top = np.full(len(held), -1)

        def histogram(batches, shared=shared, now=now):
            low, width, need = now.value
            counts = np.zeros((len(low), BINS), dtype=np.int64)
            for at, _, s in _scores(batches, shared.value):
                with np.errstate(invalid="ignore", divide="ignore"):
                    b = np.floor((s - low[at]) / width[at])
                ok = (b >= 0) & (b < BINS)
                cell = (at[None, :] * BINS + np.where(ok, b, 0).astype(np.int64))[ok]
                counts += np.bincount(cell, minlength=counts.size).reshape(counts.shape)
            above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
            q, b = np.nonzero((counts > 0) & (above < need[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[q, b], pa.int64())], names=["q", "bin", "n"])

        summed = rows.mapInArrow(histogram, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin"))) - F.col("n")
        limits = spark.createDataFrame([(i, int(n)) for i, n in enumerate(need)], "q int, need long")
        # One row for each query of the block comes back: the bin with its k-th value, or its lowest bin if it has fewer rows.
        cut = summed.withColumn("before", before).join(F.broadcast(limits), "q").filter("before < need").groupBy("q").agg(F.min("bin").alias("bin"), F.min_by("before", "bin").alias("before"), F.min_by("n", "bin").alias("n"))
        loose = 0
        for r in cut.collect():
            top[r["q"]] = r["bin"]
            need[r["q"]] -= r["before"]
            loose += r["n"] > 4 * k
        now.destroy()
        found = top >= 0
        low = np.where(found, low + top * width, low)
        # A hair of slack below keeps a value that rounding puts at the other side of an edge.
        low = low - 1e-9 * np.maximum(1, np.abs(low))
        width = np.where(found, width * (1 + 1e-6) / BINS, width)
        if not loose or not (width * BINS > 0.5).any():
            break
    floor = spark.sparkContext.broadcast(low)

    def best(batches):
        low, kept = floor.value, {}
        for at, own, s in _scores(batches, shared.value):
            hit = s >= low[at]
            hit &= np.isfinite(s)
            for j in np.nonzero(hit.any(axis=0))[0]:
                (i,) = np.nonzero(hit[:, j])
                v, w = kept.get(at[j], (np.empty(0), np.empty(0, dtype=np.int64)))
                v, w = np.concatenate([v, s[i, j]]), np.concatenate([w, own[i]])
                order = np.lexsort((w, -v))[:k]
                kept[at[j]] = v[order], w[order]
        for q, (v, w) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), ids[q]), pa.int64()), pa.array(w, pa.int64()), pa.array(v, pa.float64())], names=["query_id", "id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    led = rows.mapInArrow(best, "query_id long, id long, score double").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return led.select("query_id", "rank", "id", "score"), [shared, floor]


def quantised(vectors: DataFrame, vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Each component x as floor(scale * x), a double; null and non-finite ones stay for :func:`usable` to see."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.withColumn(vec_col, F.transform(F.col(vec_col).cast("array<double>"), lambda x: F.when(bad(x), x).otherwise(F.floor(x * scale).cast("double"))))

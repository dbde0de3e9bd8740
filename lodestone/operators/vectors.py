"""An index of vectors: cells of k-means as a partitioned table, searched with a proof that unread cells hold nothing nearer.

Rows without a direction (null, empty, zero or non-finite vectors, or another
dimension than the centroids') are in no cell and are never found; queries without
one have no hits.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shared_dir
from .retrieval import HITS

#: Rows that centroids are fitted on at most, by hash of their ids; the most cells; cells that a query reads first; queries at once.
SAMPLE, CELLS, PROBES, BLOCK = 50_000, 4096, 4, 1024
#: Distances are rounded to 6 places, so a cell stays out only if it is farther by more than that.
SLACK = 2e-6


def _norm(c: str) -> Column:
    return F.sqrt(F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


@dataclass
class Index:
    """``path``: rows (cell, id, embedding, norm) by cell. Cells' unit centroids, and the greatest angle of a row to its own, by cell number."""

    path: str
    centroids: np.ndarray
    radius: dict[int, float]
    rows: dict[int, int]


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def build(chunks: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 1) -> Index:
    """Index rows (id, embedding): centroids by k-means on a sample of bounded size, every row in the cell of its nearest one."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = chunks.sparkSession
    usable = chunks.select("id", "embedding").withColumn("norm", _norm("embedding")).filter((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    size, total = usable.agg(F.mode(F.size("embedding"), True), F.count("*")).first()
    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    empty = Index(path, np.empty((0, 0)), {}, {})
    if not total:
        return empty
    usable = usable.filter(F.size("embedding") == size)
    chosen = usable.filter(F.pmod(F.xxhash64("id"), F.lit(total)) < sample).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=cells or max(1, min(CELLS, round(math.sqrt(total)))), seed=seed, maxIter=10, distanceMeasure="cosine").fit(chosen)
    centroids = np.array(model.clusterCenters(), dtype=np.float64)
    centroids = centroids[np.linalg.norm(centroids, axis=1) > 0]
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast(centroids)

    def deal(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            v = _matrix(batch.column(1))
            dots = (v / batch.column(2).to_numpy()[:, None]) @ shared.value.T
            cell = dots.argmax(axis=1)
            angle = np.arccos(np.clip(dots[np.arange(len(v)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle), pa.array(cell, pa.int32())], names=["id", "embedding", "norm", "angle", "cell"])

    kind = dict(usable.dtypes)
    dealt = usable.mapInArrow(deal, f"id {kind['id']}, embedding {kind['embedding']}, norm double, angle double, cell int")
    dealt.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    found = spark.read.parquet(path).groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect()  # a row for each cell
    return Index(path, centroids, {r["cell"]: r["r"] for r in found}, {r["cell"]: r["n"] for r in found})


def _scored(index: Index, spark, wanted: dict[int, list[int]], q: np.ndarray, n: int) -> DataFrame:
    """(q, id, distance) of the n nearest rows of each task in the cells that queries want; only these cells' folders are read."""
    shared = spark.sparkContext.broadcast((wanted, q))
    rows = spark.read.parquet(index.path).filter(F.col("cell").isin(list(wanted))).select("cell", "id", "embedding", "norm")

    def score(batches: Iterator[pa.RecordBatch]):
        wanted, q = shared.value
        best: dict[int, tuple[np.ndarray, list]] = {}
        for batch in batches:
            cell, ids, norm = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(3).to_numpy()
            v = _matrix(batch.column(2))
            for c in np.unique(cell).tolist():
                (at,) = np.nonzero(cell == c)
                asked = wanted[c]
                distance = np.round(1 - (v[at] @ q[asked].T) / norm[at][:, None], 6)
                for j, k in enumerate(asked):
                    d, own = best.get(k, (np.empty(0), []))
                    near, here = range(len(own)), distance[:, j]
                    d = np.concatenate([d, here])
                    if len(d) > n:  # those up to the n-th distance, of which ids decide
                        near = np.flatnonzero(d <= np.partition(d, n - 1)[n - 1])
                    named = sorted((d[i], own[i] if i < len(own) else ids[at[i - len(own)]]) for i in near)[:n]
                    best[k] = np.array([x for x, _ in named]), [x for _, x in named]
        for k, (d, own) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(own), pa.int32()), pa.array(own, kind), pa.array(d)], names=["q", "id", "distance"])

    sql = dict(rows.dtypes)["id"]
    kind = {"string": pa.string(), "int": pa.int32()}.get(sql, pa.int64())
    return rows.mapInArrow(score, f"q int, id {sql}, distance double")


def _best(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def search(index: Index, queries: DataFrame, n: int = HITS, probes: int = PROBES, block: int = BLOCK, exact: bool = True, read: list | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the ``n`` nearest rows to each query (query_id, vector), as :func:`retrieval.search` gives them.

    A query reads the ``probes`` cells with the nearest centroids. No row of a cell is nearer by angle than the centroid's less
    the cell's radius; so of the others, with ``exact``, it reads those where that is no more than its n-th hit so far. Queries
    pass the driver in blocks, and each block's hits are written. ``read`` gets (query_id, cells read, rows in them).
    """
    spark, path = queries.sparkSession, f"{shared_dir(queries.sparkSession)}/hits-{uuid.uuid4().hex}"
    kind = dict(queries.dtypes)["query_id"]
    rows = queries.select("query_id", "vector").toLocalIterator()
    schema = None
    while held := list(itertools.islice(rows, block)):
        held = [r for r in held if r["vector"] and len(r["vector"]) == index.centroids.shape[1] and None not in r["vector"]]
        q = np.array([r["vector"] for r in held], dtype=np.float64).reshape(len(held), index.centroids.shape[1])
        norm = np.linalg.norm(q, axis=1)
        some = np.flatnonzero(np.isfinite(norm) & (norm > 0))
        if not len(some):
            continue
        q, names = q[some] / norm[some, None], [held[i]["query_id"] for i in some]
        cells = np.array(sorted(index.radius))
        angle = np.arccos(np.clip(q @ index.centroids[cells].T, -1, 1))
        bound = 1 - np.cos(np.maximum(angle - np.array([index.radius[c] for c in cells]), 0))
        first = np.zeros(angle.shape, dtype=bool)
        np.put_along_axis(first, np.argsort(angle, axis=1)[:, :probes], True, axis=1)
        wanted = lambda mask: {int(cells[c]): np.flatnonzero(mask[:, c]).tolist() for c in np.flatnonzero(mask.any(axis=0))}
        hits = _best(_scored(index, spark, wanted(first), q, n), n).select("q", "id", "distance").collect()  # n rows for each query of the block
        far = np.full(len(q), np.inf)
        for k, own in itertools.groupby(sorted(hits, key=lambda r: r["q"]), key=lambda r: r["q"]):
            own = list(own)
            if len(own) == n:
                far[k] = max(r["distance"] for r in own)
        rest = ~first & (bound <= far[:, None] + SLACK) if exact else np.zeros_like(first)
        kept = spark.createDataFrame(hits, f"q int, id {dict(spark.read.parquet(index.path).dtypes)['id']}, distance double")
        found = kept if not rest.any() else kept.unionByName(_scored(index, spark, wanted(rest), q, n))
        named = spark.createDataFrame(list(enumerate(names)), f"q int, query_id {kind}")
        out = _best(found, n).join(F.broadcast(named), "q").select("query_id", "id", "distance", "rank")
        schema = out.schema
        out.write.mode("append").parquet(path)
        if read is not None:
            each = first | rest
            read += [(name, int(m.sum()), sum(index.rows[int(c)] for c in cells[m])) for name, m in zip(names, each, strict=True)]
    if schema is None:
        return spark.createDataFrame([], f"query_id {kind}, id long, distance double, rank int")
    return spark.read.schema(schema).parquet(path)

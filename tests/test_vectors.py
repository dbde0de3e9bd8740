import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import retrieval, vectors


def clustered(n, dimension, centres, seed=3, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dimension))
    return [(i, (middle[i % centres] + spread * rng.normal(size=dimension)).astype("float32").tolist()) for i in range(n)]


def tables(spark, rows):
    chunks = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = chunks.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return chunks, asked


def test_the_index_gives_what_the_whole_search_gives_and_reads_a_share(spark):
    chunks, asked = tables(spark, clustered(2000, 16, 25))
    read = []
    index = vectors.build(chunks)
    got = sorted(map(tuple, vectors.search(index, asked, probes=2, block=16, read=read).collect()))
    assert got == sorted(map(tuple, retrieval.search(chunks, asked).collect())) and len(got) == 400
    # Most of the table stays unread, and the folders of unread cells aren't in the plan.
    assert sum(rows for _, _, rows in read) / len(read) < 0.2 * 2000 and sum(index.rows.values()) == 2000
    one = vectors._scored(index, spark, {0: [0]}, np.ones((1, 16)), 3)
    assert "PartitionFilters" in one._jdf.queryExecution().executedPlan().toString() and len(one.inputFiles()) >= 1


def test_vectors_without_order_or_direction(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 5) for i in range(40)]  # ties, for smaller ids
    chunks, asked = tables(spark, rows)
    want = sorted(map(tuple, retrieval.search(chunks, asked, 7).collect()))
    bad = spark.createDataFrame([(500, None), (501, []), (502, [0.0] * 5), (503, [float("inf")] * 5), (504, [1.0, 2.0]), (505, [None] * 5), (550, [float("nan")] * 5)], "id long, embedding array<float>")
    index = vectors.build(chunks.unionByName(bad), cells=9)
    assert sorted(map(tuple, vectors.search(index, asked.unionByName(bad.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))), 7, probes=1).collect())) == want
    assert vectors.search(index, asked.limit(0)).count() == 0 and vectors.search(vectors.build(chunks.limit(0)), asked).count() == 0
    # Without the exact finish: recall, and ranks without gaps.
    loose = vectors.search(index, asked, 7, probes=3, exact=False)
    hits = {tuple(r) for r in loose.select("query_id", "id").collect()} & {(q, i) for q, i, _, _ in want}
    assert len(hits) >= 0.5 * len(want)

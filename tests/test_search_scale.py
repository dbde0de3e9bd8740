"""Searches choose candidates by matrix products, and lose nothing by it."""

import numpy as np

from lodestone.operators import retrieval
from tests.test_scale import rows_made


def test_search_scores_few_pairs_in_full_and_equals_brute_force(spark):
    made = np.random.default_rng(5).normal(size=(3000, 8)).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(made)] + [(3000 + i, made[7].tolist()) for i in range(30)]
    chunks = spark.createDataFrame(rows, "id long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame(rows[:40], "query_id long, vector array<double>")
    found = retrieval.search(chunks, queries)
    v = np.array([r[1] for r in rows])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    distance = np.round(1 - unit[:40] @ unit.T, 6) + 0.0
    want = {(q, int(i), k + 1) for q in range(40) for k, i in enumerate(np.lexsort((np.arange(len(v)), distance[q]))[:10])}
    assert {(r["query_id"], r["id"], r["rank"]) for r in found.collect()} == want
    assert rows_made(found) < 3030 * 40 / 4


def test_search_keeps_vectors_with_nulls_and_none(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, None]), (3, None), (4, [0.0, 1.0])]
    chunks = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, vector array<double>")
    found = retrieval.search(chunks, queries)
    assert {tuple(r) for r in found.collect()} == {(1, 2, None, 1), (1, 3, None, 2), (1, 1, 0.0, 3), (1, 4, 1.0, 4)} | {(2, i, None, i) for i in (1, 2, 3, 4)}
    assert retrieval.search(chunks, queries.limit(0)).count() == 0

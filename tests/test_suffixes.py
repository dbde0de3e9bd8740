import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import suffixes


def words(rng, n):
    return ["".join(rng.choice("abé") for _ in range(rng.randrange(9))) for _ in range(n)]


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_against_all_pairs(spark, parts):
    rng = random.Random(parts)
    keys = {t: (rng.randrange(50), f"p{i}") for i, t in enumerate([*words(rng, 150), "x" * 30, "yx" * 4])}
    asked = [*words(rng, 120), "", "x" * 10, "x" * 40, "none", *list(keys)[:9]]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        k = spark.createDataFrame([(t, a, b, f"v{t}") for t, (a, b) in keys.items()], "text string, a int, b string, value string").select("text", F.struct("a", "b").alias("first"), "value")
        w = spark.createDataFrame([(t,) for t in asked], "text string")
        got = {r["text"]: (tuple(r["first"]), r["value"]) for r in suffixes.least(k, w).collect()}
        want = {}
        for t in asked:
            hits = [(first, f"v{key}") for key, first in keys.items() if key.endswith(t) or t.endswith(key)]
            if hits:
                want[t] = min(hits)
        assert got == want
        pairs = sorted(map(tuple, suffixes.ending_with(k.select("text", F.col("value").alias("id")), w).collect()))
        assert pairs == sorted((t, f"v{key}") for t in set(asked) for key in keys if key.endswith(t))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert suffixes.least(k.limit(0), w).count() == 0 and suffixes.ending_with(k.select("text", F.col("value").alias("id")), w.limit(0)).count() == 0


def test_rows_that_are_shuffled_are_linear(spark):
    """Long texts make no more rows: what goes over by range is one row for each text, and a few before each range."""
    n = 300
    k = spark.createDataFrame([("x" * 200 + f"{i:04d}", (i,), f"v{i}") for i in range(n)], "text string, first struct<a:int>, value string")
    rows = k.select("text", "first", "value")
    assert suffixes._ranges(rows).count() <= n + 4 * 205

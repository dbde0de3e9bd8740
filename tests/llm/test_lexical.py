import math
import random
import re

import duckdb
import pytest

from lodestone.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return TERM.findall((text or "").translate(SMALL))


def plainly(docs, items, k):
    """Sorted (item, rank, score) and, for each item, the (id, score) of all documents, by loops."""
    split = [(i, words(t)) for i, t in docs]
    split = [(i, w) for i, w in split if w]
    N, L = len(split), sum(len(w) for _, w in split)
    out = []
    for item, text in set(items):
        found = []
        for i, w in split:
            score = 0
            for term in words(text):
                tf = w.count(term)
                if tf:
                    df = sum(term in x for _, x in split)
                    weight = math.floor(1000 * math.log((2 * N + 2) / (2 * df + 1)))
                    score += weight * (1000000000 * tf // (1000 * tf + 12 * (100 - 25 + 25 * len(w) * N // L)))
            if score:
                found.append((-score, i is not None, i or 0))
        out += [(item, r + 1, i if some else None, -s) for r, (s, some, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def got(frame):
    return sorted(map(tuple, frame.select("item_id", "rank", "id", "score").collect()), key=repr)


@pytest.mark.parametrize("window, block, k", [(7, 1 << 20, 20), (1 << 14, 40, 3), (1, 1, 5)])
def test_against_plain_loops(spark, window, block, k):
    rng = random.Random(window)
    vocabulary = [f"w{int(30 * rng.random() ** 3)}" for _ in range(200)] + ["É", "é", "Ünï", "數字", "x y", "1-2", "a_b", "\x7f", "ÀB"]
    docs = [(i * 7 % 90 - 5, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 40))).upper() if i % 3 else "".join(rng.choices(vocabulary, k=5))) for i in range(90)]
    docs += [(None, "w1 w2 w3"), (None, None), (2000, None), (2001, ""), (2002, " -- "), *[(3000 + i, "w0 w1 tie") for i in range(30)], *[(4000, "tie tie")] * 5, (5000, "w3 " * 3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=8))) for i in range(12)] + [(50, None), (51, ""), (52, "unknown words"), (53, "tie"), (54, "w1 " * 40), (54, "w1 " * 40), (None, "w2 É")]
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert got(lexical.search(table, asked, k, window=window, block=block)) == plainly(docs, items, k)


def test_windows_bounded_by_postings(spark, monkeypatch):
    docs = [(i, " ".join(f"t{j}" for j in range(i % 11))) for i in range(60)]
    items = [(j, f"t{j} t{j + 1} t0") for j in range(9)]
    monkeypatch.setattr(lexical, "POSTINGS", 15)
    table, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(lexical.search(table, asked, 4)) == plainly(docs, items, 4)


def test_empty_tables_and_clashing_items(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert got(lexical.search(docs, items)) == plainly([(1, "a b")], [(1, "a")], 20)
    with pytest.raises(ValueError):
        lexical.search(docs, spark.createDataFrame([(1, "a"), (1, "b")], "item_id long, text string"))


def test_factors_beyond_64_bits():
    import numpy as np

    n = np.array([5, 1 << 50], dtype=np.int64)
    assert lexical.factors(n, 1 << 40, 1 << 60).tolist() == [75 + 25 * int(x) * (1 << 40) // (1 << 60) for x in n]


def test_the_query_and_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    found = queries.op12_ranked_search(spark, folder)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = db.execute(queries.SQL["op12_ranked_search"]).fetchall()
    assert want and sorted(map(tuple, found.collect())) == sorted(want)

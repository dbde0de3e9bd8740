import hashlib
import random
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import merkle, queries


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, at):
    """(left, right) of each level."""
    out = []
    for nodes in tree[:-1]:
        first = at // 8 * 8
        out.append((nodes[first:at], nodes[at + 1 : first + 8]))
        at //= 8
    return out


def plainly(rows):
    """Sorted results of (grp, id, leaf, now)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([r[2] for r in sorted(groups[g], key=lambda r: (r[1] is not None, r[1] or 0, r[2]))]) for g in names}
    top, out = levels([trees[g][-1][0] for g in names]), []
    for k, g in enumerate(names):
        for i, r in enumerate(sorted(groups[g], key=lambda r: (r[1] is not None, r[1] or 0, r[2]))):
            way = siblings(trees[g], i) + siblings(top, k)
            node = r[3] or r[2]
            for left, right in way:
                node = H(*left, node, *right)
            out.append((r[1], r[2], trees[g][-1][0], top[-1][0], H(*(x for left, right in way for x in left + right)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def made(spark, rows, parts, fan=64, most=None):
    table = spark.createDataFrame(rows, "grp string, id long, leaf string, now string").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        return sorted(map(tuple, merkle.proofs(merkle.manifest(table, fan=fan)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("parts, fan", [(1, 64), (5, 2), (23, 3)])
def test_against_plain_trees(spark, parts, fan):
    rng = random.Random(parts)
    rows = []
    for g, n in ((None, 9), ("en", 700), ("de", 65), ("é", 8), ("z", 1), ("", 64), *((f"x{i:03d}", 1 + i % 9) for i in range(70))):
        for i in range(n):
            leaf = H(g or "", str(i))
            rows.append((g, None if i == 3 else i * 5, leaf, H(leaf) if rng.random() < 0.3 else None))
    rows += [rows[20]] * 40  # rows that repeat
    assert made(spark, rows, parts, fan) == plainly(rows)


@pytest.mark.parametrize("rows", [[("a", 1, H("x"), None)], [(None, None, H("x"), H("y"))], [("a", i, H("x"), None) for i in range(9)], [(f"{i}", 1, H(str(i)), None) for i in range(9)]])
def test_small_tables(spark, rows):
    assert made(spark, rows, 2) == plainly(rows)


def test_an_empty_table(spark):
    empty = spark.createDataFrame([], "grp string, id long, leaf string")
    found = merkle.manifest(empty)
    assert found.root is None and merkle.proofs(found).count() == 0


@given(st.lists(st.integers(1, 40), min_size=1, max_size=5), st.randoms(use_true_random=False))
@settings(max_examples=80, deadline=None)
def test_forests_merge_in_any_order(counts, rng):
    """The monoid: leaves in any pieces, pieces in any grouping, give the same root."""
    leaves = {(t, 0, i): H(str((t, i))).encode() for t, n in enumerate(counts) for i in range(n)}
    sizes = dict(enumerate(counts)) | {merkle.TOP: len(counts)}
    forests = []
    for key, node in rng.sample(list(leaves.items()), len(leaves)):
        forests.append(merkle.Forest(sizes))
        forests[-1].add(key, node)
    while len(forests) > 1:
        a, b = (forests.pop(rng.randrange(len(forests))) for _ in range(2))
        for key, node in b.nodes.items():
            a.add(key, node)
        forests.append(a)
    top = levels([levels([leaves[t, 0, i].decode() for i in range(n)])[-1][0] for t, n in enumerate(counts)])
    assert list(forests[0].nodes) == [(merkle.TOP, len(top) - 1, 0)] and forests[0].nodes.popitem()[1].decode() == top[-1][0]


def test_digests_of_rows(spark):
    rows = [(1, None, "é", ""), (None, "a", "bc", None)]
    table = spark.createDataFrame(rows, "a long, b string, c string, d string")
    got = [r[0] for r in table.select(merkle.digest([F.col(c) for c in "abcd"])).collect()]
    assert got == [H("1:1-2:é0:"), H("-1:a2:bc-")]


def test_the_query(spark):
    folder, up = "/root/testdata/sf0.001", str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    rows = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        leaf = lambda text: H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))  # noqa: B023, E731
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        rows.append((r["lang"], r["doc_id"], leaf(r["text"]), leaf(r["text"] and r["text"].translate(up)) if changed else None))
    got = queries.op11_merkle_manifest(spark, folder)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, got.collect()), key=repr)
    assert got == plainly(rows)
    assert 0 < sum(r[-1] for r in got) < len(got)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert sorted(db.execute(queries.SQL["op11_merkle_manifest"]).fetchall(), key=repr) == got

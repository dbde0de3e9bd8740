"""A Merkle manifest of a table, by sparse forests that merge.

Rows are leaves. Each group's leaves, in order of id, are one tree; the groups'
roots, in order of the group, are the leaves of the top tree. While a level has
several nodes, every ARITY consecutive ones, fewer at the end, become their
digest.

Leaves are sorted by range, so a partition holds a stretch of positions. Its
forest keeps the nodes whose parent isn't known yet, by (tree, level, index): a
few for each level at both ends of the stretch, as a run of siblings becomes its
parent as soon as all of it is there. How many siblings a run has is known from
the sizes of trees. Forests merge in any grouping, to the same nodes. The tree
reduction puts FAN neighbouring forests together in each round (``treeReduce``
would deal them by number modulo its width, so that no siblings met), and ends
each round in a written table. So the driver sees no node but the root.

What a reduction makes are the nodes that lie over several partitions. With those
next to its own stretch, a partition has every sibling on the ways to the root.

Defined cases: null groups are a group, and the first; null ids come first in
theirs. Rows that repeat group and id are in order of their digests. Null values
are ``-``. The lone leaf of a group is its root, and a lone group's root the root.
An empty table has no root and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import slices
from .common import written

#: Siblings of a full run; forests that a task merges; rows of a partition, more or less; rows of an output batch.
ARITY, FAN, ROWS, AT_ONCE = 8, 64, 1 << 18, 4096
#: The number of the top tree.
TOP = -1


def digest(columns: Sequence[Column]) -> Column:
    """SHA-256 in hexadecimal of the values, each ``-`` if null, else its bytes' count, a colon and the value."""
    values = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]).cast("binary"), 256)


def parent(children: bytes) -> bytes:
    """The digest, as hexadecimal text, of the children's."""
    return hashlib.sha256(children).hexdigest().encode()


@dataclass
class Forest:
    """Nodes by (tree, level, index); ``sizes`` has the leaves of every tree that isn't whole here, and of the top tree."""

    sizes: dict[int, int]
    nodes: dict[tuple[int, int, int], bytes] = field(default_factory=dict)
    made: dict[tuple[int, int, int], bytes] = field(default_factory=dict)
    levels: dict[int, list[int]] = field(default_factory=dict)

    def count(self, tree: int, level: int) -> int:
        """How many nodes a level up to the root has."""
        known = self.levels.get(tree)
        if known is None:
            known = self.levels[tree] = [self.sizes[tree]]
            while known[-1] > 1:
                known.append(-(-known[-1] // ARITY))
        return known[level]

    def run(self, key: tuple[int, int, int]) -> range:
        """The indices of a node's run of siblings."""
        first = key[2] // ARITY * ARITY
        return range(first, min(first + ARITY, self.count(*key[:2])))

    def add(self, key: tuple[int, int, int], node: bytes, keep: bool = False) -> None:
        """Add a node, and make the parents of all runs that it completes. Children go then, unless ``keep``."""
        while True:
            tree, level, index = key
            if self.count(tree, level) == 1 and tree != TOP:
                if keep:
                    self.nodes[key] = node
                key = (TOP, 0, tree)
                self.made[key] = node
                continue
            self.nodes[key] = node
            run = self.run(key)
            if self.count(tree, level) == 1 or not all((tree, level, i) in self.nodes for i in run):
                return
            node = parent(b"".join([self.nodes[tree, level, i] for i in run]))
            if not keep:
                for i in run:
                    del self.nodes[tree, level, i]
            key = (tree, level + 1, index // ARITY)
            self.made[key] = node

    def path(self, key: tuple[int, int, int], held: dict) -> tuple:
        """(siblings left, siblings right) of the node and all above it, and these joined; ``held`` keeps a node for each level."""
        tree, level, index = key
        if self.count(tree, level) == 1:
            return ((), b"") if tree == TOP else self.path((TOP, 0, tree), held)
        known = held.get((tree, level))
        if known is None or known[0] != index // ARITY:
            known = held[tree, level] = index // ARITY, self.path((tree, level + 1, index // ARITY), held)
        steps, joined = known[1]
        run = self.run(key)
        left = b"".join([self.nodes[tree, level, i] for i in range(run.start, index)])
        right = b"".join([self.nodes[tree, level, i] for i in range(index + 1, run.stop)])
        return ((left, right), *steps), left + right + joined


@dataclass
class Stretch:
    """What a partition holds: trees by number, the first leaf's place in its tree, and sizes of the first and the last tree."""

    first: int
    last: int
    start: int
    sizes: dict[int, int]


@dataclass
class Manifest:
    """Leaves (part, n, grp, id, leaf, now), nodes that lie over partitions, the root, and what each partition holds."""

    leaves: DataFrame
    nodes: DataFrame | None
    root: str | None
    groups: int
    parts: dict[int, Stretch]


def _stretches(leaves: DataFrame) -> tuple[dict[int, Stretch], int]:
    """Stretches by partition, and the number of groups: one row for each partition comes to the driver."""
    runs = leaves.groupBy("part", "grp").agg(F.count("*").alias("n")).withColumn("g", F.struct(F.col("grp").isNotNull().alias("some"), F.col("grp").alias("name")))
    rows = runs.groupBy("part").agg(F.min("g").alias("a"), F.max("g").alias("z"), F.min_by("n", "g").alias("head"), F.max_by("n", "g").alias("tail"), F.count("*").alias("runs"))
    out, tree, before, place = {}, -1, None, 0
    sizes: dict[int, int] = {}
    for r in sorted(rows.collect(), key=lambda r: r["part"]):
        a, z = tuple(r["a"]), tuple(r["z"])
        if a != before:
            tree, place = tree + 1, 0
        first, start = tree, place
        sizes[first] = start + r["head"]
        tree += r["runs"] - 1
        if r["runs"] > 1:
            sizes[tree] = r["tail"]
        place = sizes[tree]
        before = z
        out[r["part"]] = Stretch(first, tree, start, {})
    for s in out.values():
        s.sizes = {t: sizes[t] for t in (s.first, s.last)} | {TOP: tree + 1}
    return out, tree + 1


def _places(batches: Iterator[pa.RecordBatch], parts: dict[int, Stretch]) -> Iterator[tuple]:
    """(part, tree, its number of leaves in the part so far, row) of leaves in order."""
    at, group, tree, place = None, None, 0, 0
    for part in slices(batches, "leaf", 1 << 16):
        for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if row[0] != at:
                at, group = row[0], row[2]
                tree, place = parts[at].first, parts[at].start
            elif row[2] != group:
                group, tree, place = row[2], tree + 1, 0
            yield at, tree, place, row
            place += 1


def _runs(batches: Iterator[pa.RecordBatch], parts: dict[int, Stretch]) -> Iterator[tuple[int, list]]:
    """(part, its rows as (tree, place, row)) of one partition after the other."""
    at, held = None, []
    for k, tree, place, row in _places(batches, parts):
        if k != at:
            if held:
                yield at, held
            at, held = k, []
        held.append((tree, place, row))
    if held:
        yield at, held


def _forest(stretch: Stretch, held: list, keep: bool, known: dict | None = None) -> Forest:
    """The forest of a partition's leaves; ``known`` are nodes next to it."""
    sizes = dict(stretch.sizes)
    for tree, place, _ in held:
        if tree not in (stretch.first, stretch.last):
            sizes[tree] = place + 1
    forest = Forest(sizes)
    for tree, place, row in held:
        forest.add((tree, 0, place), row[4].hex().encode(), keep)
    forest.nodes |= known or {}
    return forest


NODE = "part long, tree long, level int, idx long, node binary, new boolean, open boolean"


def _rows(part: int, forest: Forest, first: bool) -> pa.RecordBatch:
    """The forest's nodes, and what it made on its way."""
    keys = [*forest.nodes, *(k for k in forest.made if k not in forest.nodes)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part] * len(keys), pa.int64()),
            pa.array([k[0] for k in keys], pa.int64()),
            pa.array([k[1] for k in keys], pa.int32()),
            pa.array([k[2] for k in keys], pa.int64()),
            pa.array([forest.nodes.get(k) or forest.made[k] for k in keys], pa.binary()),
            pa.array([first or k in forest.made for k in keys]),
            pa.array([k in forest.nodes for k in keys]),
        ],
        names=["part", "tree", "level", "idx", "node", "new", "open"],
    )


def manifest(rows: DataFrame, part_rows: int = ROWS, fan: int = FAN) -> Manifest:
    """The manifest of (grp string, id long, leaf string) and, if the row's content has changed since, ``now`` string."""
    spark = rows.sparkSession
    own = F.unhex("now") if "now" in rows.columns else F.lit(None).cast("binary")
    narrow = written(rows.select("grp", "id", F.unhex("leaf").alias("leaf"), own.alias("now"), F.monotonically_increasing_id().alias("tie")), "leaves")
    order = ["grp", "id", "leaf", "tie"]
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-narrow.count() // part_rows))
    ranged = narrow.repartitionByRange(number, *order).sortWithinPartitions(*order)
    leaves = written(ranged.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n"), "grp", "id", "leaf", "now"), "ordered")
    parts, groups = _stretches(leaves)
    if not parts:
        return Manifest(leaves, None, None, 0, {})
    shared = spark.sparkContext.broadcast(parts)

    def fragments(batches):
        for part, held in _runs(batches, shared.value):
            forest = _forest(shared.value[part], held, keep=False)
            forest.made.clear()
            yield _rows(part, forest, True)

    dealt = leaves.drop("now", "id").select("part", "n", "grp", F.lit(None).cast("long").alias("id"), "leaf").repartition(number, "part").sortWithinPartitions("part", "n")
    tables = [written(dealt.mapInArrow(fragments, NODE), "nodes")]
    left = max(parts) + 1
    while left > 1:
        left = -(-left // fan)

        def merge(batches):
            part, forest = None, None
            for batch in batches:
                for k, tree, level, idx, node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if k != part:
                        if forest:
                            yield _rows(part, forest, False)
                        part, forest = k, Forest(sizes.value)
                    forest.add((tree, level, idx), node)
            if forest:
                yield _rows(part, forest, False)

        sizes = spark.sparkContext.broadcast({t: n for s in parts.values() for t, n in s.sizes.items()})
        held = tables[-1].filter("open").select(F.expr(f"part div {fan}").alias("part"), "tree", "level", "idx", "node")
        tables.append(written(held.repartition("part").sortWithinPartitions("part").mapInArrow(merge, NODE), "nodes"))
    (root,) = tables[-1].filter("open").select("node").take(2)  # one node is left
    nodes = tables[0].filter("new")
    for t in tables[1:]:
        nodes = nodes.unionByName(t.filter("new"))
    return Manifest(leaves, nodes.select("tree", "level", "idx", "node"), bytes(root["node"]).decode(), groups, parts)


def _needed(part: int, s: Stretch, lengths: dict[int, tuple[int, int]]) -> Iterator[tuple]:
    """(part, tree, level, index) of the runs at the ends of a partition's stretch in each of its trees."""
    forest, seen = Forest(s.sizes), set()
    for tree, (a, b) in lengths.items():
        level = 0
        while forest.count(tree, level) > 1:
            for i in {*forest.run((tree, level, a)), *forest.run((tree, level, b))}:
                seen.add((part, tree, level, i))
            a, b, level = a // ARITY, b // ARITY, level + 1
        if tree == TOP:
            seen.add((part, TOP, 0, s.first))
    yield from seen


PROOF = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(found: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    ``proof_sha256`` is the digest of all siblings up to the root; ``folded_root`` what these and the content's digest
    (``now``, where it is given) make of the root, and ``verified`` whether that is the root.
    """
    spark, parts, root = found.leaves.sparkSession, found.parts, found.root
    if root is None:
        return spark.createDataFrame([], PROOF)
    shared = spark.sparkContext.broadcast(parts)
    tails = found.leaves.groupBy("part", "grp").agg(F.count("*").alias("n"), F.max("n").alias("at"))
    ends = tails.groupBy("part").agg(F.max_by("n", "at").alias("tail"))

    def needed(batches):
        for batch in batches:
            for part, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shared.value[part]
                # Where the stretch begins and ends in its first and its last tree: a tree that goes on starts or ends at its own end.
                first_end = s.start + tail - 1 if s.first == s.last else s.sizes[s.first] - 1
                lengths = {s.first: (s.start, first_end)}
                if s.last != s.first:
                    lengths[s.last] = (0, tail - 1)
                rows = list(_needed(part, s, lengths | {TOP: (s.first, s.last)}))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["part", "tree", "level", "idx"])

    around = ends.mapInArrow(needed, "part long, tree long, level int, idx long").join(found.nodes, ["tree", "level", "idx"])
    none = lambda kind: F.lit(None).cast(kind)
    rows = found.leaves.select(F.col("part").cast("long").alias("part"), "n", "grp", "id", "leaf", "now", none("long").alias("tree"), none("int").alias("level"), none("long").alias("idx"))
    extra = around.select("part", F.lit(-1).cast("long").alias("n"), none("string").alias("grp"), none("long").alias("id"), F.col("node").alias("leaf"), none("binary").alias("now"), "tree", "level", "idx")

    def prove(batches):
        known: dict = {}

        def only_leaves():
            """Leaves; the nodes before them are put aside, by partition."""
            for batch in slices(batches, "leaf", 1 << 16):
                columns = [c.to_pylist() for c in batch.columns]
                keep = []
                for i, n in enumerate(columns[1]):
                    if n < 0:
                        known.setdefault(columns[0][i], {})[columns[6][i], columns[7][i], columns[8][i]] = columns[4][i]
                    else:
                        keep.append(i)
                if keep:
                    yield batch.take(pa.array(keep))

        for part, held in _runs(only_leaves(), shared.value):
            forest, seen = _forest(shared.value[part], held, True, known.pop(part, None)), {}
            for i in range(0, len(held), AT_ONCE):
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*(_proof(forest, seen, tree, place, row, root) for tree, place, row in held[i : i + AT_ONCE]), strict=True))), names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]).cast(OUT)

    both = rows.unionByName(extra).repartition(max(1, len(parts)), "part").sortWithinPartitions("part", "n")
    return both.mapInArrow(prove, PROOF)


OUT = pa.schema([("id", pa.int64()), *[(n, pa.string()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])


def _proof(forest: Forest, seen: dict, tree: int, place: int, row: tuple, root: str) -> tuple:
    """A row's proof, and the root that its content folds to."""
    steps, joined = forest.path((tree, 0, place), seen)
    now = (row[4] if row[5] is None else row[5]).hex().encode()
    for left, right in steps:
        now = parent(left + now + right)
    folded = now.decode()
    return row[3], row[4].hex(), forest.nodes[TOP, 0, tree].decode(), root, hashlib.sha256(joined).hexdigest(), folded, folded == root

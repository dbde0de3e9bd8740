"""SimHash near-duplicates, linked by BK-trees over shards of fingerprints.

Equal fingerprints are one node. Two fingerprints that differ in r bits or fewer
agree in at least one of r + 1 blocks of bits, so a shard is all fingerprints
with one value of one block, and every link lies in some shard. In a shard, a
BK-tree holds the fingerprints, children keyed by their Hamming distance to the
parent; a search follows only edges within the radius. A shard of more than
SHARD fingerprints is cut into pieces: the tree of each piece is sent to as many
tasks as there are pieces to search it, so no tree and no task outgrows its
bound. A task gives only links that join two of its groups: fewer than it has
fingerprints, however dense they are, and with the same components.

Defined cases: null and white texts have fingerprint zero and are linked like
any other; documents of one id are separate rows; a null id is no component's
least unless there is no other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import mapped, slices
from .common import file_system, fresh, new_path, put_file, written
from .components import components, hot_from, spread_join

SEED, WORDS, RADIUS = 42, 3, 2
#: Most fingerprints of a tree.
SHARD = 20_000
#: Least hashes that make a shard's key together; the share of pairs at just the least similarity that share a shard.
TOGETHER, RECALL = 3, 0.995
#: Standard deviations that the radius of candidates is above the expected distance; bytes of shingle sets that a task keeps.
DEVIATIONS, HELD = 3, 16 << 20
#: Bytes of a node's name, the digest of its set.
NAME = 16
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16


def hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of the text's shingles, repeats included. bytes.lower and bytes.split know ASCII only, as they should."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    f, join = xxhash.xxh64_intdigest, b" ".join
    grams = zip(*(w[i:] for i in range(words))) if len(w) >= words else [w]  # noqa: B905
    return np.array([f(join(g), seed) for g in grams], dtype=np.uint64)


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the numbers have each bit. Sums of 255 rows fit a byte."""
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), COUNTED):
        bits = np.unpackbits(h[i : i + COUNTED].view(np.uint8), bitorder="little").reshape(-1, 64)
        whole = len(bits) // 255 * 255
        total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return total


def fingerprint(h: np.ndarray) -> int:
    """Bits that are 1 in more than half of the hashes; 0 without any."""
    return int(np.packbits(2 * _ones(h) > len(h), bitorder="little").view(np.uint64)[0]) if len(h) else 0


def wide_fingerprint(h: np.ndarray, bits: int) -> bytes:
    """A fingerprint of more bits: each 64 are those of the hashes mixed anew."""
    out = []
    for k in range(bits // 64):
        x = h + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        out.append(np.packbits(2 * _ones(x ^ x >> np.uint64(31)) > len(h), bitorder="little").tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id, fp): the fingerprint's bits as a signed long."""

    def run(batches):
        for part in slices(batches, "text"):
            fp = np.array([fingerprint(hashes(t, words, seed)) for t in part.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, fp long")


class Tree:
    """A BK-tree of integers under Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        n = len(self.values)
        self.values.append(x)
        self.children.append({})
        at = 0
        while n:
            below = self.children[at]
            d = (x ^ self.values[at]).bit_count()
            if d not in below:
                below[d] = n
                return
            at = below[d]

    def within(self, x: int, radius: int) -> Iterator[int]:
        """Places of the values at ``radius`` or less from ``x``."""
        held = [0] if self.values else []
        values, children = self.values, self.children
        while held:
            at = held.pop()
            d = (x ^ values[at]).bit_count()
            if d <= radius:
                yield at
            below = children[at]
            for e in range(d - radius, d + radius + 1):
                if e in below:
                    held.append(below[e])


def links(own: Iterable[int], asked: Iterable[int] | None, radius: int) -> Iterator[tuple[int, int]]:
    """Links within ``radius`` that join groups: among ``own``, or (where given) between ``asked`` and ``own``."""
    tree, place, top = Tree(), {}, []

    def root(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    def joined(x, i):
        for j in tree.within(x, radius):
            a, b = root(i), root(j)
            if a != b:
                top[a] = b
                yield x, tree.values[j]

    for x in own:
        if x not in place:
            place[x] = len(top)
            top.append(len(top))
            if asked is None:
                yield from joined(x, place[x])
            tree.add(x)
    for x in asked or ():
        if x not in place:
            place[x] = len(top)
            top.append(len(top))
            yield from joined(x, place[x])


def link_fingerprints(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``nodes.fp`` that give the components of all links within ``radius``."""
    edges = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    block = lambda lo, hi: F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))
    keys = F.array(*[F.struct(F.lit(i).alias("block"), block(lo, hi).alias("value")) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))])
    return link_shards(nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.block", "k.value"), radius, shard)


def link_shards(keyed: DataFrame, radius: int, shard: int = SHARD, finder: Callable | None = None) -> DataFrame:
    """(a, b): links within ``radius`` that join groups in each shard of (fp, block, value); ``fp`` is a long or a binary.

    A task calls ``finder`` once for a function to be used instead of :func:`links`; it gets and gives binaries.
    """
    counts = keyed.groupBy("block", "value").agg(F.count("*").alias("n")).filter("n > 1")
    pieces = F.ceil(F.col("n") / shard).cast("int")
    dealt = keyed.join(counts, ["block", "value"]).withColumn("pieces", pieces).withColumn("piece", F.pmod(F.xxhash64(F.lit(1), "fp"), "pieces").cast("int"))
    # A piece meets each later piece, whose fingerprints search its tree, and itself.
    pairs = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda other: F.struct(F.least("piece", other).alias("i"), F.greatest("piece", other).alias("j")))
    spread = dealt.withColumn("p", F.explode(pairs)).select("block", "value", "p.i", "p.j", (F.col("piece") != F.col("p.i")).alias("asks"), "fp")
    # Whether a row's fingerprints build the tree or search it; the tree comes first.
    ordered = spread.repartition("block", "value", "i", "j").sortWithinPartitions("block", "value", "i", "j", "asks", "fp")
    kind = dict(keyed.dtypes)["fp"]
    number = (lambda x: int.from_bytes(x, "little")) if kind == "binary" else (lambda x: x & (1 << 64) - 1)

    def column(values, size):
        if kind == "binary":
            return pa.array([x.to_bytes(size, "little") for x in values], pa.binary())
        return pa.array(np.array(values, dtype=np.uint64).view(np.int64))

    def run(batches):
        key, own, asked = None, [], []
        search = finder() if finder else None

        def out():
            if search:
                found = list(search(own, asked if key[2] != key[3] else None, radius)) if len(own) + len(asked) > 1 else []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], names=["a", "b"])
                return
            found = list(links(map(number, own), map(number, asked) if key[2] != key[3] else None, radius)) if len(own) + len(asked) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([column(c, len((own or asked)[0]) if kind == "binary" else 8) for c in zip(*found, strict=True)], names=["a", "b"])

        for batch in batches:
            for *k, asks, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if key is not None:
                        yield from out()
                    key, own, asked = k, [], []
                (asked if asks else own).append(fp)
        if key is not None:
            yield from out()

    return mapped(ordered, run, f"a {kind}, b {kind}")


def _named(prints: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``prints`` with each fingerprint's component: the least id among the fingerprints that links reach. ``nodes``: (fp, least, n).

    Nodes are named by their own least id, null last, and the fingerprint, so a component's least node names it, and no group
    has to meet in one task to find it.
    """
    names = nodes.select("fp", F.struct(F.col("least").isNull().alias("no"), F.col("least").alias("id"), "fp").alias("name"))
    end = lambda c, name: names.select(F.col("fp").alias(c), F.col("name").alias(name))
    found = components(links.join(end("a", "u"), "a").join(end("b", "v"), "b").select("u", "v"), "u", "v")
    # Only nodes with a link are among those found.
    rooted = found.filter("node.fp <> root.fp").select(F.col("node.fp").alias("fp"), F.col("root.id").alias("id"))
    given = nodes.join(rooted, "fp", "left").select("fp", F.when(rooted["fp"].isNotNull(), F.col("id")).otherwise(F.col("least")).alias("component"), "n")
    given, limit = written(given, "given"), hot_from(prints.count())
    return spread_join(prints, given, "fp", None if given.filter(F.col("n") > limit).isEmpty() else limit)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS, shard: int = SHARD) -> DataFrame:
    """(id, fp, component): each document's fingerprint and the least id that links of ``radius`` bits or fewer reach."""
    prints = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "nodes")
    return _named(prints, nodes, link_fingerprints(nodes.select("fp"), radius, shard)).select("id", "fp", "component")


def expected(similarity: float) -> float:
    """The share of differing bits between fingerprints of two sets of equal size with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bands(similarity: float, recall: float = RECALL) -> int:
    """Keys of a set, so that two of this similarity have one in common with chance ``recall``; the same however many sets there are."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**TOGETHER))


def shard_keys(h: np.ndarray, count: int) -> np.ndarray:
    """A set's keys: each of TOGETHER least values of its hashes mixed anew. Two sets agree in a least value with the chance of their similarity."""
    if not len(h):
        return np.zeros(count, dtype=np.int64)
    rng = np.random.default_rng(12)
    a, b = (rng.integers(1, 1 << 62, (2, count * TOGETHER), dtype=np.int64) | 1).astype(np.uint64)
    least = np.full(count * TOGETHER, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(h), COUNTED // 16):
        x = (h[i : i + COUNTED // 16, None] ^ b) * a
        least = np.minimum(least, ((x ^ x >> np.uint64(31)) * a).min(axis=0))
    key = np.zeros(count, dtype=np.uint64)
    for own in least.reshape(count, TOGETHER).T:
        key = (key ^ own) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


class Sets:
    """Sorted shingle sets in files of ``folder``, read where a node says; HELD bytes of them are kept."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.start, self.held, self.size = folder, bits // 8 + NAME, OrderedDict(), 0

    def count(self, node: bytes) -> int:
        return int.from_bytes(node[self.start + 24 :], "little")

    def get(self, node: bytes) -> np.ndarray:
        if node in self.held:
            self.held.move_to_end(node)
            return self.held[node]
        filesystem, path = file_system(f"{self.folder}/{node[self.start : self.start + 16].hex()}")
        with filesystem.open_input_file(path) as f:
            f.seek(int.from_bytes(node[self.start + 16 : self.start + 24], "little"))
            found = self.held[node] = np.frombuffer(f.read(8 * self.count(node)), np.uint64)
        self.size += found.nbytes
        while self.size > HELD and len(self.held) > 1:
            self.size -= self.held.popitem(last=False)[1].nbytes
        return found

    def similar(self, x: bytes, y: bytes, similarity: float) -> bool:
        """Whether the sets' Jaccard similarity is ``similarity`` or more."""
        low, high = sorted((self.count(x), self.count(y)))
        if low < similarity * high - 1e-9:
            return False
        shared = len(np.intersect1d(self.get(x), self.get(y), assume_unique=True))
        return shared >= similarity * (low + high - shared) - 1e-9


def verified(own: Iterable[bytes], asked: Iterable[bytes] | None, radius: int, size: int, similar: Callable[[bytes, bytes], bool]) -> Iterator[tuple[bytes, bytes]]:
    """Names of linked nodes, as :func:`links`: nodes start with a fingerprint of ``size`` bytes and their name, and only links that are ``similar`` join groups."""
    tree, place, members, top = Tree(), {}, [], {}

    def root(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    def joined(x, fp):
        for i in tree.within(fp, radius):
            for y in members[i]:
                a, b = root(x), root(y)
                if a != b and similar(x, y):
                    top[a] = b
                    yield x[size : size + NAME], y[size : size + NAME]

    for many, grows in ((own, True), (asked or (), False)):
        for x in many:
            if x not in top:
                top[x], fp = x, int.from_bytes(x[:size], "little")
                if asked is None or not grows:
                    yield from joined(x, fp)
                if grows:
                    if fp not in place:
                        place[fp] = len(members)
                        members.append([])
                        tree.add(fp)
                    members[place[fp]].append(x)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words: int = 5, bits: int = 256, shard: int = SHARD) -> DataFrame:
    """(id, h, component): near-duplicates by shingles of more words and a lower similarity than blocks of equal bits could find.

    Texts with the same set of shingles are one node. Fingerprints of the sets have ``bits`` bits; candidates are pairs within
    the distance expected at ``similarity`` and DEVIATIONS standard deviations more that share a shard. A set is in a fixed
    number of shards, keyed by least hashes of its shingles (see :func:`bands`), as at this distance bits of fingerprints agree
    too often by chance; the shards' BK-trees are searched as those of :func:`near_duplicates`. A first search finds the fingerprints with candidates. The sets of only these are written to files, and a second search
    compares each candidate's set before it joins groups, so every link has an exact Jaccard similarity of ``similarity`` or
    more (of sets of 64-bit hashes). ``h`` is a hash of the text.
    """
    share, size = expected(similarity), bits // 8
    radius = int(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share)))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))

    def run(batches):
        for part in slices(batches, "text"):
            fp, name, keys = [], [], []
            for t in part.column(2).to_pylist():
                own = np.unique(hashes(t, words))
                fp.append(wide_fingerprint(own, bits))
                name.append(xxhash.xxh128_digest(own.tobytes()))
                keys.append(shard_keys(own, count))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp, pa.binary()), pa.array(name, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "h", "fp", "name", "keys"])

    count = bands(similarity)
    prints = written(mapped(rows, run, "id long, h long, fp binary, name binary, keys array<long>"), "fingerprints")
    nodes = written(prints.groupBy("name").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min("id").alias("least"), F.min(F.struct("id", "h")).alias("r"), F.count("*").alias("n")), "nodes")
    several = nodes.groupBy("fp").agg(F.count("*").alias("n"))
    shards = lambda some: some.select("fp", F.posexplode("keys").alias("block", "value"))
    found = link_shards(shards(nodes), radius, shard).select(F.explode(F.array("a", "b")).alias("fp"))
    near = written(found.unionByName(several.filter("n > 1").select("fp")).distinct(), "near")
    picked = nodes.join(near, "fp", "left_semi").select(F.col("r.id").alias("__id"), F.col("r.h").alias("__h"))
    folder = new_path(docs.sparkSession, "sets")

    def store(batches):
        """A node for each text, with the place of its set; a file for each part."""
        for part in slices(batches, "text"):
            file, at, out, parts, keys = uuid.uuid4(), 0, [], [], []
            for t in part.column(0).to_pylist():
                own = np.unique(hashes(t, words))
                raw = own.tobytes()
                parts.append(raw)
                out.append(wide_fingerprint(own, bits) + xxhash.xxh128_digest(raw) + file.bytes + at.to_bytes(8, "little") + len(own).to_bytes(8, "little"))
                keys.append(shard_keys(own, count))
                at += len(raw)
            put_file(f"{folder}/{file.hex}", parts)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["fp", "keys"])

    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))
    stored = written(mapped(rows.join(picked, same, "left_semi").select("text"), store, "fp binary, keys array<long>"), "stored")
    # Repeated rows gave one name several places.
    once = stored.groupBy(F.substring("fp", 1, size + NAME).alias("k")).agg(F.min("fp").alias("fp"), F.first("keys").alias("keys")).select("fp", "keys")

    def finder():
        sets = Sets(folder, bits)
        return lambda own, asked, radius: verified(own, asked, radius, size, lambda x, y: sets.similar(x, y, similarity))

    links = link_shards(shards(once), radius, shard, finder)
    named = _named(prints.select("id", "h", F.col("name").alias("fp")), nodes.select(F.col("name").alias("fp"), "least", "n"), links)
    return named.select("id", "h", "component")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay: of each component of :func:`similar_documents`, the one with the least id (null first, then by the text's hash).

    Of rows with that id and text, the one with the least other columns stays. Other columns may have any names.
    """
    found = similar_documents(docs, id_col, text_col, similarity, words)
    key, mark, row, n = fresh(docs.columns, "__id", "__h", "__row", "__n")
    kept = written(found.groupBy("component").agg(F.min(F.struct("id", "h")).alias("k"), F.count("*").alias("n")).select(F.col("k.id").alias(key), F.col("k.h").alias(mark), F.col("n").alias(n)), "kept")
    own = {key: F.col(f"`{id_col}`").cast("long"), mark: F.xxhash64(F.col(f"`{text_col}`").cast("string"))}
    pairs = lambda a, b: a[key].eqNullSafe(b[key]) & (a[mark] == b[mark])
    rows = docs.withColumns(own)
    rows = rows.join(kept, pairs(rows, kept), "left_semi")
    # Rows repeated whole are dealt with only where there are any; each task makes one of those that it has, so no group meets in one.
    several = found.select(F.col("id").alias(key), F.col("h").alias(mark))
    several = several.join(kept.filter(F.col(n) > 1), pairs(several, kept), "left_semi").groupBy(key, mark).agg(F.count("*").alias(n)).filter(F.col(n) > 1)
    if several.isEmpty():
        return rows.select(docs.columns)
    several = written(several, "repeated")
    once = rows.join(several, pairs(rows, several), "left_semi").groupBy(key, mark).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(row)).select(f"{row}.*")
    return rows.join(several, pairs(rows, several), "left_anti").select(docs.columns).unionByName(once)

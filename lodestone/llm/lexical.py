"""Ranked lexical search by windowed bucket scoring.

Documents become narrow rows: their number of terms, and which of the asked terms
they hold how often. A task puts its rows in order of doc_id and goes through
their postings in windows of WINDOW documents. In a window, each of an item's
terms adds its scores to an array of the window's documents, and its bits to the
bitset of documents met; the documents met are harvested into the item's heap of
the k best. Arrays and bitsets of a window fit in a core's cache. Heaps of all
tasks are merged by rank.

Weights need the number of documents, of their terms, and of documents that hold
each term. These are sums over all rows, made before any is scored.

Scores are 64-bit integers, as the contract of :func:`search` says; a document's
length factor that would not fit into 64 bits on its way is made by Python's
integers. Defined cases: null texts, and those without terms, count as no
documents. Null ids rank before others of equal score; rows that repeat an id
are documents of their own. Items without terms, and with terms that no document
holds, have no rows; neither has an empty table. Items that repeat id and text
count once; with other texts, an id is an error.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import slices
from .common import new_path, written

#: Documents of a window, whose scores, 8 bytes each, fit in a core's cache; fewer if they have so many postings; terms in more than one of FEW documents have bits.
WINDOW, POSTINGS, FEW = 1 << 14, 1 << 21, 64
#: Bytes of the texts of items that are broadcast together, but for a single longer one.
BLOCK = 4 << 20
#: ASCII letters and digits and all bytes of other characters are terms; the rest stands between them. Capital letters of ASCII become small.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, repeats included."""
    return text.translate(_TERMS).split()


def forward(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, terms, tfs) of every row with terms: how many, and the numbers and counts of those in ``vocabulary``, as little-endian integers of 32 and 64 bits."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def count(batches):
        known = shared.value.get
        for part in slices(batches, "text"):
            ids, n, found, tfs = part.column(0).to_pylist(), [], [], []
            for text in part.column(1).to_pylist():
                words = terms(text)
                held = Counter(map(known, words))
                held.pop(None, None)
                n.append(len(words))
                found.append(np.fromiter(held, "<u4", len(held)).tobytes())
                tfs.append(np.fromiter(held.values(), "<i8", len(held)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(found, pa.binary()), pa.array(tfs, pa.binary())], names=["id", "n", "terms", "tfs"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(count, "id long, n long, terms binary, tfs binary").filter("n > 0")


def frequencies(rows: DataFrame, size: int) -> DataFrame:
    """(term, df): how many rows hold each of ``size`` terms; tasks sum up before the shuffle."""

    def count(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=size)
        (at,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "df"])

    return rows.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def factors(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Each document's 100 - 25 + 25 * n * documents div total."""
    if len(n) and 25 * int(n.max()) * documents >= 1 << 63:
        return np.array([75 + 25 * int(x) * documents // total for x in n], dtype=np.int64)
    return 75 + 25 * n * documents // total


class Heaps:
    """The k best documents of each item, as (score, -place in the task's order, id)."""

    def __init__(self, items: int, k: int):
        self.heaps, self.k = [[] for _ in range(items)], k

    def harvest(self, item: int, slots: np.ndarray, scores: np.ndarray, base: int, ids: list) -> None:
        """Take in the scores of the window's documents at ``slots``. Later documents lose against equal ones."""
        heap = self.heaps[item]
        (at,) = np.nonzero(scores > (heap[0][0] if len(heap) == self.k else 0))
        if len(at) > self.k:  # none below the window's own k-th score is among the best
            at = at[scores[at] >= np.partition(scores[at], len(at) - self.k)[len(at) - self.k]]
        for slot, score in zip(slots[at].tolist(), scores[at].tolist(), strict=True):
            entry = score, -(base + slot), ids[slot]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif score > heap[0][0]:
                heapq.heapreplace(heap, entry)


class Postings:
    """The postings of one window by term: documents, what the term adds to their scores, and bits of the documents if there are many."""

    def __init__(self, size: int, slots: np.ndarray, found: np.ndarray, gain: np.ndarray):
        order = np.argsort(found, kind="stable")
        slots, gain = slots[order], gain[order]
        numbers, starts = np.unique(found[order], return_index=True)
        self.terms, flags = {}, np.zeros(size, dtype=bool)
        ends = np.append(starts, len(slots))[1:]
        for t, a, b in zip(numbers.tolist(), starts.tolist(), ends.tolist(), strict=True):
            bits = None
            if b - a > size // FEW:
                flags[slots[a:b]] = True
                bits = np.packbits(flags, bitorder="little")
                flags[slots[a:b]] = False
            self.terms[t] = slots[a:b], gain[a:b], bits


def score_window(ids: list, n: np.ndarray, found: np.ndarray, tfs: np.ndarray, many: np.ndarray, asked: tuple, heaps: Heaps, base: int) -> None:
    """Score one window's documents for every item. ``many``: how many postings each document has; ``found`` and ``tfs``: these, document by document."""
    items, weights, documents, total = asked
    slots = np.repeat(np.arange(len(n)), many)
    m = factors(n, documents, total)[slots]
    postings = Postings(len(n), slots, found, weights[found] * (1_000_000_000 * tfs // (1000 * tfs + 12 * m))).terms
    scores, met = np.zeros(len(n), dtype=np.int64), np.zeros((len(n) + 7) // 8, dtype=np.uint8)
    for item, own in enumerate(items):
        for term, times in own:
            if (p := postings.get(term)) is not None:
                at, gain, bits = p
                scores[at] += gain if times == 1 else times * gain
                if bits is None:
                    np.bitwise_or.at(met, at >> 3, (1 << (at & 7)).astype(np.uint8))
                else:
                    met |= bits
        at = np.flatnonzero(np.unpackbits(met, count=len(n), bitorder="little"))
        if len(at):
            heaps.harvest(item, at, scores[at], base, ids)
            scores[at], met[:] = 0, 0


def _windows(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[tuple]:
    """(ids, n, terms, tfs, postings of each) of ``size`` documents, or fewer that have ``most`` postings, as they come."""
    ids, n, found, tfs, held = [], [], [], [], 0

    def full():
        many = np.array([len(f) // 4 for f in found], dtype=np.int64)
        return ids, np.array(n, dtype=np.int64), np.frombuffer(b"".join(found), "<u4"), np.frombuffer(b"".join(tfs), "<i8"), many

    for batch in slices(batches, "tfs", size):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(ids) >= size or ids and held + len(row[2]) // 4 > most:
                yield full()
                ids, n, found, tfs, held = [], [], [], [], 0
            for column, value in zip((ids, n, found, tfs), row, strict=True):
                column.append(value)
            held += len(row[2]) // 4
    if ids:
        yield full()


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, id, score): each item's k highest-scoring documents with a score above 0, equal scores by ascending id.

    A document's score sums, over an item's terms with repeats, w * (1000000000 tf div (1000 tf + 12 m)): w is
    floor(1000 ln((2 N + 2) / (2 df + 1))), m is 75 + 25 n N div L, N counts documents with terms, L their terms.
    Items pass the driver in blocks of ``block`` bytes, each block's result being written before the next is read.
    """
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "ranked")
    schema = "item_id long, rank int, id long, score long"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    asked = items.select(F.col(item_col).cast("long").alias("id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).cast("binary").alias("text")).distinct()
    if asked.groupBy("id").count().filter("count > 1").take(1):
        raise ValueError("items that share an id have different texts")
    for held in _blocks(asked.orderBy("id").toLocalIterator(), block):
        _block(docs, held, k, id_col, text_col, window).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _blocks(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of items with terms, of ``size`` bytes at most, but for single longer ones."""
    held, total = [], 0
    for r in rows:
        if held and total + len(r["text"]) > size:
            yield held
            held, total = [], 0
        if own := terms(bytes(r["text"])):
            held.append((r["id"], own))
            total += len(r["text"])
    if held:
        yield held


def _block(docs: DataFrame, held: list, k: int, id_col: str, text_col: str, window: int) -> DataFrame:
    """The ranked documents of a block of items."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    for _, own in held:
        for term in own:
            vocabulary.setdefault(term, len(vocabulary))
    items = [sorted(Counter(vocabulary[t] for t in own).items()) for _, own in held]
    names = [i for i, _ in held]
    rows = written(forward(docs, vocabulary, id_col, text_col), "forward")
    documents, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for r in frequencies(rows, len(vocabulary)).collect():  # one row for each term of the block
        weights[r["term"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1)))
    shared = spark.sparkContext.broadcast((items, weights, documents, total))

    def rank(batches):
        heaps, base = Heaps(len(names), k), 0
        for window_ids, *rest in _windows(batches, window, POSTINGS):
            score_window(window_ids, *rest, shared.value, heaps, base)
            base += len(window_ids)
        for name, heap in zip(names, heaps.heaps, strict=True):
            if heap:
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(heap), pa.int64()), pa.array([e[2] for e in heap], pa.int64()), pa.array([e[0] for e in heap], pa.int64())], names=["item_id", "id", "score"])

    found = rows.sortWithinPartitions("id").mapInArrow(rank, "item_id long, id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "id", "score")

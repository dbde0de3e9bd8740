"""Benchmark decontamination under edit distance.

Documents and items are sequences of lower-cased words. An item of n words is
leaked by a document that holds words at an edit distance of floor(n / 5) words
or less from it (similarity 0.8 and more).

Item-sized windows of documents and the items themselves go through CGK random
walks, which turn edits into differing places: a walk copies the word that it
stands on and moves on or not by a hash of step and word. Repeated samples of
places of several walks are the keys of a hash table of the items; windows that
share a key with an item are candidates, and an exact edit distance decides.
The number of samples follows from a target recall and the walks' agreement that
is measured at each length, see :func:`needed`. Only items of more than LONGEST
words, or of more edits than samples can bridge, have no keys: each group of runs (below) is a candidate of theirs.

Not every place of a document needs a window: an item within k edits has at
least n - q + 1 - kq of its runs of q words in common with the words that leak
it, and all on diagonals at most k apart (the q-gram lemma). Windows start on
just the diagonals of such groups of runs, which loses nothing.

The items are broadcast in blocks of ITEMS, and of WORDS words but for a longer
item; each block takes a pass over the documents. Common runs that would meet too
many items are looked at for some of the items at a time. Defined cases: null texts and texts without words leak nothing, items
without words are never leaked; items of fewer than 5 words must occur as they
are; repeated items and documents give repeated rows; empty tables give an empty
result.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import mapped, slices
from .common import new_path, written

#: Edits that an item may have, as a share of its words.
EDITS = 0.2
#: Items and their words in a broadcast block; meetings of runs and items that are held at once.
ITEMS, WORDS, HITS = 20_000, 200_000, 1 << 20
#: Random walks; places in a sample; the share of leaks that some sample shall find.
WALKS, PLACES, RECALL = 16, 3, 0.999
#: Words of the longest items with keys; pairs that agreement is measured on; words of windows that walk at once.
LONGEST, TRIALS, AT_ONCE = 512, 128, 1 << 16
#: The most samples of a walk: more than EDITS needs at any length that has keys.
MOST = 256
#: Characters that are hashed at once, so that the arrays stay small however long a text is.
PIECE = 1 << 20

_BREAK = re.compile("[ -¿×÷ -⁯　-〿＀-／﻿]")
_WORD = np.zeros(256, dtype=bool)
for _lo, _hi in ((ord("a"), ord("z")), (ord("0"), ord("9")), (0x80, 0xFF)):
    _WORD[_lo : _hi + 1] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the hash's base and of its inverse, as many as were needed so far."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
                up[0] = down[0] = 1
                cls.up, cls.down = np.cumprod(up), np.cumprod(down)
        return cls.up[:n], cls.down[:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text's place) of each word of the texts, in order. Words are runs of letters and digits; bytes from 128 on count as letters, but for punctuation."""
    joined = "\0".join(t.replace("\0", " ") for t in texts).lower()
    if not joined.isascii():
        joined = _BREAK.sub(" ", joined)
    raw = np.frombuffer(joined.encode(), np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = _WORD[raw]
    step = np.diff(inside)
    starts, ends = np.nonzero(step == 1)[0], np.nonzero(step == -1)[0]
    owner = np.searchsorted(np.nonzero(raw == 0)[0], starts)
    up, down = _Powers.of(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32), owner


def cut(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of a text that end where a word does."""
    at = 0
    space = re.compile(r"\s")
    while len(text) - at > size:
        stop = next((m.end() for m in [space.search(text, at + size)] if m), len(text))
        yield text[at:stop]
        at = stop
    yield text[at:]


def document_words(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, place of the text) of the words of all texts, some texts at a time."""
    held, first, size = [], 0, 0
    for i, t in enumerate(texts):
        if held and size + len(t) > PIECE:
            h, owner = word_hashes(held)
            yield h, owner + first
            held, first, size = [], i, 0
        if len(t) > PIECE:
            h = np.concatenate([word_hashes([p])[0] for p in cut(t)])
            yield h, np.full(len(h), i)
            first = i + 1
        else:
            held.append(t)
            size += len(t)
    if held:
        h, owner = word_hashes(held)
        yield h, owner + first


@functools.cache
def _constants(step: int) -> tuple[np.ndarray, np.ndarray]:
    """Two odd numbers for each walk."""
    a, b = np.random.default_rng([11, step]).integers(1, 1 << 62, (2, WALKS, 1), dtype=np.int64).astype(np.uint64) | np.uint64(1)
    return a, b


def _bits(step: int, symbols: np.ndarray) -> np.ndarray:
    """0 or 1 for each word (walks x rows), by a hash of walk and step."""
    a, b = _constants(step)
    x = (symbols.astype(np.uint64) + b) * a
    return ((x ^ x >> np.uint64(31)) * b >> np.uint64(47) & np.uint64(1)).astype(np.int64)


def embed(words: np.ndarray) -> np.ndarray:
    """CGK walks over rows of n words: walks x rows x 2n places. Places past a row's end hold -1."""
    rows, n = words.shape
    padded = np.concatenate([words, np.full((rows, 1), -1, dtype=words.dtype)], axis=1)
    at, every, out = np.zeros((WALKS, rows), dtype=np.int64), np.arange(rows), np.empty((WALKS, rows, 2 * n), dtype=words.dtype)
    for step in range(2 * n):
        out[:, :, step] = now = padded[every, np.minimum(at, n)]
        at += _bits(step, now)
    return out


@functools.cache
def samples(n: int, count: int) -> np.ndarray:
    """The places of each sample: walks x ``count`` x PLACES."""
    rng = np.random.default_rng([7, n])
    return rng.random((WALKS, count, 2 * n)).argpartition(min(PLACES, 2 * n) - 1, axis=2)[:, :, : min(PLACES, 2 * n)]


def keys(words: np.ndarray, count: int) -> np.ndarray:
    """The table keys of rows of n words: one for each walk and sample."""
    out, places = [], embed(words)
    for walk, own in enumerate(samples(words.shape[1], count)):
        chosen = places[walk][:, own].astype(np.uint64) + np.uint64(2)
        h = np.broadcast_to((walk * 1000 + 1 + np.arange(count)).astype(np.uint64), chosen.shape[:2])
        for p in range(chosen.shape[2]):
            h = (h ^ chosen[:, :, p]) * np.uint64(_BASE)
            h = h ^ h >> np.uint64(31)
        out.append(h)
    return np.concatenate(out, axis=1)


def grid(n: int) -> int:
    """The least of 2, 3, 4, 6, 8, 12, 16, 24, .. from n on: agreement is measured at these lengths, and is no better at longer ones."""
    power = 1 << max(0, n - 1).bit_length()
    return 3 * power // 4 if power >= 4 and 3 * power // 4 >= n else power


@functools.cache
def needed(n: int, slack: int) -> int:
    """Samples of each walk for RECALL of leaks of n words with ``slack`` edits, by the measured agreement of walks on replaced and on mixed edits; 0 if more than MOST, as where nearly all words may be edited."""
    agree = []
    for mixed in (False, True):
        rng = np.random.default_rng([n, slack])
        pairs = []
        for _ in range(TRIALS):
            own = rng.integers(1, 1 << 40, n)
            other = own.tolist()
            for at in sorted(rng.choice(n, slack, replace=False).tolist(), reverse=True):
                kind = int(rng.integers(3)) if mixed else 0
                other[at : at + (kind < 2)] = [int(rng.integers(1, 1 << 40))] * (kind != 1)
            pairs.append((own, np.resize(np.array([*other, *rng.integers(1, 1 << 40, n)]), n)))
        a, b = (np.stack(x) for x in zip(*pairs, strict=True))
        agree.append((embed(a) == embed(b)).mean(axis=2))
    missed = 1 - np.array(agree) ** PLACES
    return next((c for c in range(1, MOST + 1) if (missed**c).prod(axis=1).mean(axis=1).max() <= 1 - RECALL), 0)


def edits(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """(least edit distance of the item to any run of ``words``, where the run ends)."""
    row = np.zeros(len(words) + 1, dtype=np.int64)
    ramp = np.arange(len(words) + 1)
    for i, x in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (words != x))
        row = np.minimum.accumulate(new - ramp) + ramp
    end = int(row.argmin())
    return int(row[end]), end


class Items:
    """A block of items, ready to be searched for."""

    def __init__(self, rows: list[tuple[int, str]], share: float = EDITS):
        self.names = [r[0] for r in rows]
        hashes = [word_hashes([t or ""])[0] for _, t in rows]
        self.vocabulary = np.unique(np.concatenate([*hashes, np.empty(0, np.uint64)]))
        # Words get numbers from 1; 0 is any other word.
        self.words = [np.searchsorted(self.vocabulary, h).astype(np.int64) + 1 for h in hashes]
        self.slack = [int(share * len(w) + 1e-9) if len(w) >= 5 else 0 for w in self.words]
        runs: dict[int, list] = defaultdict(list)
        self.need = []
        for i, (w, k) in enumerate(zip(self.words, self.slack, strict=True)):
            q = max(1, min(3, (len(w) - k) // (k + 1)))
            self.need.append(max(1, len(w) - q + 1 - k * q))
            runs[q] += [(tuple(w[o : o + q].tolist()), i, o) for o in range(len(w) - q + 1)]
        self.runs = {}
        for q, found in runs.items():
            found.sort()
            codes = self.code(np.array([r[0] for r in found], dtype=np.int64).reshape(-1, q).T)
            order = np.argsort(codes, kind="stable")
            codes = codes[order]
            first = np.nonzero(np.r_[True, codes[1:] != codes[:-1]])[0] if len(codes) else np.empty(0, np.int64)
            own = np.array([r[1:] for r in found], dtype=np.int64).reshape(-1, 2)[order]
            # The rank of a run's occurrence is by run, then by item.
            rank = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(codes)])) * len(self.words) + own[:, 0]
            self.runs[q] = codes[first], rank, own
        # By length; items without slack agree everywhere.
        self.count = {len(w): needed(grid(len(w)), math.ceil(share * grid(len(w)))) if k else 1 for w, k in zip(self.words, self.slack, strict=True) if len(w) <= LONGEST}
        self.direct = [not self.count.get(len(w)) for w in self.words]
        self.table: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        lengths = defaultdict(list)
        for i, w in enumerate(self.words):
            if not self.direct[i]:
                lengths[len(w)].append(i)
        for n, own in lengths.items():
            if n:
                for i, row in zip(own, keys(np.stack([self.words[i] for i in own]), self.count[n]).tolist(), strict=True):
                    for key in set(row):
                        self.table[n][key].append(i)
        self.table = {n: dict(t) for n, t in self.table.items()}

    def code(self, columns) -> np.ndarray:
        out = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            out = out * np.uint64(len(self.vocabulary) + 1) + c.astype(np.uint64)
        return out

    def places(self, words: np.ndarray, owner: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By q, the places where a run of q words begins that some item has, too, and which run it is."""
        out = {}
        for q, (codes, _, _) in self.runs.items():
            if len(words) < q or not len(codes):
                continue
            n = len(words) - q + 1
            fit = owner[:n] == owner[q - 1 :]
            for j in range(q):
                fit &= words[j : n + j] > 0
            (at,) = np.nonzero(fit)
            c = self.code([words[at + j] for j in range(q)])
            run = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
            ok = codes[run] == c
            out[q] = at[ok], run[ok]
        return out

    def anchors(self, places: dict, owner: np.ndarray, low: int, high: int) -> Iterator[np.ndarray]:
        """Rows (text, item, diagonal): a run that text and an item from ``low`` to ``high`` have in common. Some items at a time, all of an item's rows together."""
        spans = {}
        for q, (at, run) in places.items():
            _, rank, _ = self.runs[q]
            spans[q] = [np.searchsorted(rank, run * len(self.words) + i) for i in (low, high)]
        if sum(int((b - a).sum()) for a, b in spans.values()) > HITS and high - low > 1:
            yield from self.anchors(places, owner, low, (low + high) // 2)
            yield from self.anchors(places, owner, (low + high) // 2, high)
            return
        out = [np.empty((0, 3), np.int64)]
        for q, (a, b) in spans.items():
            own, many = self.runs[q][2], b - a
            which = np.repeat(a, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = np.repeat(places[q][0], many)
            out.append(np.stack([owner[at], own[which, 0], at - own[which, 1]], axis=1))
        yield np.concatenate(out)

    def windows(self, words: np.ndarray, owner: np.ndarray) -> tuple[dict[int, np.ndarray], list[tuple[int, int, int]]]:
        """By length n, the starts of windows of n words: the diagonals of groups of enough runs. For items without keys, (text, item, first diagonal) of each group."""
        out: dict[int, set] = defaultdict(set)
        groups: list[tuple[int, int, int]] = []
        for found in self.anchors(self.places(words, owner), owner, 0, len(self.words)):
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            need, slack = np.array([*self.need, 0])[found[:, 1]], np.array([*self.slack, 0])[found[:, 1]]
            last = np.arange(len(found)) + need - 1
            ok = last < len(found)
            end = np.minimum(last, len(found) - 1)
            ok &= (found[end, :2] == found[:, :2]).all(axis=1) & (found[end, 2] - found[:, 2] <= slack) if len(found) else ok
            for i in np.nonzero(ok)[0].tolist():
                text, item, d = found[i].tolist()
                n = len(self.words[item])
                if self.direct[item]:
                    # One within slack of the last is covered by its reach.
                    if not groups or groups[-1][:2] != (text, item) or d - groups[-1][2] > self.slack[item]:
                        groups.append((text, item, d))
                else:
                    out[n].update(range(d, d + self.slack[item] + 1))
        return {n: np.array(sorted(s)) for n, s in out.items()}, groups

    def leaks(self, h: np.ndarray, owner: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """{(text, item): (edits, first word)} of what the words leak; the fewest edits, then the first place."""
        place = np.minimum(np.searchsorted(self.vocabulary, h), max(0, len(self.vocabulary) - 1))
        words = np.where(self.vocabulary[place] == h, place + 1, 0).astype(np.int64) if len(self.vocabulary) and len(h) else np.zeros(len(h), np.int64)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        begin = np.searchsorted(owner, np.arange((owner[-1] if len(owner) else 0) + 2))
        sampled, groups = self.windows(words, owner)
        for text, item, d in groups:
            n, slack = len(self.words[item]), self.slack[item]
            # A leak starts within slack of its group's diagonals, and has at most slack words more; a group skipped starts slack later.
            lo, hi = max(begin[text], d - 2 * slack), min(begin[text + 1], d + n + 4 * slack)
            far, end = edits(self.words[item], words[lo:hi])
            if far <= slack:
                first = int(max(0, lo + end - n - begin[text]))
                best[text, item] = min(best.get((text, item), (far, first)), (far, first))
        for n, starts in sampled.items():
            # A window may start before its text does, or end after: those places are no words.
            table = self.table.get(n, {})
            for at in np.array_split(starts, -(-len(starts) * n // AT_ONCE)):
                spot = at[:, None] + np.arange(n)
                middle = owner[np.clip(at + n // 2, 0, len(owner) - 1)]
                inside = (spot >= begin[middle][:, None]) & (spot < begin[middle + 1][:, None])
                rows = np.where(inside, words[np.clip(spot, 0, len(words) - 1)], 0)
                seen = set()
                for s, text, own in zip(at.tolist(), middle.tolist(), keys(rows, self.count[n]).tolist(), strict=True):
                    for item in set().union(*(table.get(k, ()) for k in own)):
                        slack = self.slack[item]
                        spread = max(1, slack)
                        if (text, item, s // spread) in seen:
                            continue
                        seen.add((text, item, s // spread))
                        lo, hi = max(begin[text], s - 2 * spread), min(begin[text + 1], s + n + 2 * spread)
                        d, end = edits(self.words[item], words[lo:hi])
                        if d <= slack:
                            first = int(max(0, lo + end - n - begin[text]))
                            best[text, item] = min(best.get((text, item), (d, first)), (d, first))
        return best


def blocks(benchmark: DataFrame, item_id: str, item_text: str, items: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items as (id, text), in blocks."""
    held, words = [], 0
    for r in benchmark.select(F.col(item_id).cast("long"), F.col(item_text).cast("string")).toLocalIterator():
        n = len(word_hashes([r[1] or ""])[0])
        if held and (len(held) >= items or words + n > WORDS):
            yield held
            held, words = [], 0
        held.append(tuple(r))
        words += n
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = EDITS, items: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, edits, n_words, first_word): what each document leaks of each item."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, edits int, n_words int, first_word long"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    path = new_path(spark, "leaks")
    for block in blocks(benchmark, item_id, item_text, items):
        shared = spark.sparkContext.broadcast(Items(block, share))

        def run(batches, shared=shared):
            found = shared.value
            for part in slices(batches, "text"):
                names, out = part.column(0).to_pylist(), []
                for h, owner in document_words(part.column(1).to_pylist()):
                    if len(h):
                        low = owner[0]
                        out += [(names[t + low], found.names[i], d, len(found.words[i]), first) for (t, i), (d, first) in found.leaks(h, owner - low).items()]
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "edits", "n_words", "first_word"])

        mapped(rows, run, schema).write.mode("append").parquet(path)
        shared.destroy()
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = EDITS, items: int = ITEMS) -> DataFrame:
    """The rows of ``docs`` that leak no item. Rows pass as they are; nothing is shuffled. Between blocks of items they are written."""
    spark, place, shared = docs.sparkSession, docs.columns.index(text_col), None
    for block in blocks(benchmark, item_id, item_text, items):
        if shared is not None:
            docs = written(docs, "clean")
            shared.destroy()
        shared = spark.sparkContext.broadcast(Items(block, share))

        def run(batches, shared=shared):
            for part in slices(batches, text_col):
                leaking = set()
                for h, owner in document_words(["" if t is None else str(t) for t in part.column(place).to_pylist()]):
                    if len(h):
                        leaking.update(t + owner[0] for t, _ in shared.value.leaks(h, owner - owner[0]))
                yield part.filter(pa.array([i not in leaking for i in range(part.num_rows)]))

        docs = mapped(docs, run, docs.schema)
    return docs

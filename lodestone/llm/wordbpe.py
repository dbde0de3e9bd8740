"""BPE with word ends by tree concatenation.

A text longer than a leaf is cut into leaves wherever they end, also inside a
word. Leaves are encoded in parallel, each as a text of its own. Neighbours are
then joined, pair by pair, FAN leaves in a task, until a text is one node. Around
a join, windows that grow are encoded anew, until the window's ids and those of
both sides agree in an id on either side; before and after these the sides' ids
stand, between them the window's. So a node always has the ids that the library
gives for its text:

* merges never cross what two ids that stand side by side in some encoding leave
  apart, so ids of which every neighbouring pair is from one are an encoding;
* where a word ends is decided by the few characters around it, so ids that are
  nearer than MARGIN to the edge of a window or node don't count as agreement;
* no cut is made inside a special token, nor before a character that normalisation
  may change by what is before it.

Without agreement the window grows up to both whole sides, whose encoding is
exact by itself. Null texts count as empty, with no ids. All other columns are
kept, repeated rows too; ids come in ``out`` as little-endian unsigned 32-bit
integers. An own column of that name gives way to it. An empty table gives an
empty one.
"""

from __future__ import annotations

import functools
import math
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import appended, slices
from .common import fresh, written
from .tokens import Remembered, byte_letters, little

#: Characters of a leaf, leaves or nodes that a task joins, and characters at each side of a first window.
LEAF, FAN, WINDOW = 1 << 14, 16, 128
#: Pieces that a worker remembers at least, and twice as many at most; bytes of texts that are cut into pieces at once.
REMEMBERED, AT_ONCE = 150_000, 1 << 20
#: Ids (of one byte at least) next to an edge that say nothing about agreement: more than any rule of words looks over.
MARGIN = 24
#: Pieces of printable ASCII and letters of Latin-1 in composed form; their words in lower case; and the pattern of words as the file writes it, without which pieces aren't plain (fixed values).
_plain = re.compile(rb"(?:[\x21-\x7e]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
_words = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class WordEncoder:
    """Ids of texts by a tokenizer file whose words never hold ASCII white space. White space gives no ids, so what stands between is encoded piece by piece."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        added = [t.content for t in model.get_added_tokens_decoder().values()]
        if any(s.split() != [s] for s in added) or model.encode("a \t\r\n\x0b\x0c a", add_special_tokens=False).ids != model.encode("a", add_special_tokens=False).ids * 2:
            raise ValueError(f"{path} gives ids to white space")
        self.model, self.special = model, re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.reach = max(map(len, added), default=1)
        self.letters, self.plain = byte_letters(), _WORDS in model.to_str()
        self.pieces = Remembered(self._pieces, REMEMBERED)

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece. The words of plain pieces, which normalisation only makes lower-case, go to the library's merges at once, all else to the library as it is."""
        merges, letters = self.model.model.tokenize, self.letters
        out: list = [None] * len(pieces)
        for i, p in enumerate(pieces):
            if self.plain and _plain(p) and not (self.special and self.special.search(p.decode())):
                out[i] = little([t.id for w in _words(p.decode().lower()) for t in merges(w.encode().decode("latin-1").translate(letters))])
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.model.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = little(e.ids)
        return out

    def texts(self, raw: list[bytes]) -> list[bytes]:
        """The ids of each text (UTF-8), as little-endian unsigned 32-bit integers; distinct pieces are encoded once."""
        out: list[bytes] = []
        while len(out) < len(raw):
            end, held = len(out) + 1, len(raw[len(out)])
            while end < len(raw) and held + len(raw[end]) <= AT_ONCE:
                held += len(raw[end])
                end += 1
            parts = [t.split() for t in raw[len(out) : end]]
            pieces = list({x for p in parts for x in p})
            get = dict(zip(pieces, self.pieces(pieces), strict=True)).__getitem__
            out += [b"".join(map(get, p)) for p in parts]
        return out

    def window(self, text: str) -> np.ndarray:
        """The ids of a short text."""
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def cut(self, text: str, at: int) -> int:
        """The first place from ``at`` on where the text may be cut."""
        while at < len(text):
            low = max(0, at - self.reach)
            inside = next((m.end() for m in self.special.finditer(text, low, at + self.reach) if m.start() < at < m.end()), None) if self.special else None
            if inside is not None:
                at = inside
            elif text[at] < "\x80" or _stands(text[at]):
                return at
            else:
                at += 1
        return len(text)


@functools.cache
def _seconds() -> frozenset[str]:
    """Characters that normalisation may put together with one before them."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(sys.maxunicode + 1))
    found = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    # Vowels and final consonants of Hangul are composed by rule (fixed ranges of Unicode).
    return frozenset(found | set(map(chr, range(0x1161, 0x1176))) | set(map(chr, range(0x11A8, 0x11C3))))


@functools.cache
def _stands(c: str) -> bool:
    """Whether normalisation leaves ``c`` and all before it apart; unknown characters don't count."""
    return unicodedata.category(c) not in ("Cn", "Co", "Cs") and unicodedata.combining(c) == 0 and c not in _seconds() and unicodedata.is_normalized("NFC", c)


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """The encoder for a tokenizer file; a worker process keeps it from task to task."""
    return WordEncoder(path)


@functools.cache
def token_texts(path: str) -> list[bytes]:
    """The text of each id, as the vocabulary writes it."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    if model.decoder is not None:
        raise ValueError(f"{path} has a decoder of its own")
    names = {i: t for t, i in model.get_vocab(with_added_tokens=True).items()}
    return [names.get(i, "").encode() for i in range(max(names, default=-1) + 1)]


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many ids ``a`` and ``b`` begin with in common."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def joined(left: tuple[str, np.ndarray], right: tuple[str, np.ndarray], model: WordEncoder, window: int = WINDOW, margin: int = MARGIN) -> tuple[str, np.ndarray]:
    """(text, ids) of two neighbours, each (text, ids)."""
    (before, own), (after, other) = left, right
    if not before or not after:
        return before + after, np.concatenate([own, other])
    size = window
    while True:
        a = model.cut(before, len(before) - size) if size < len(before) else 0
        b = model.cut(after, size) if size < len(after) else len(after)
        middle = model.window(before[a:] + after[:b])
        first, last = 0, len(middle)
        keep_own, keep_other = 0, len(other)
        if a:
            half = model.window(before[a:])
            # An id of the left half that is in the left side and in the window: after the margin, of the ends in common, before the first difference.
            first = max(margin, len(half) - _same(half[::-1], own[::-1]))
            agreed = first < _same(half, middle)
            keep_own = len(own) - (len(half) - first)
        else:
            agreed = True
        if agreed and b < len(after):
            half = model.window(after[:b])
            u = max(margin, len(half) - _same(half[::-1], middle[::-1]))
            agreed = u < _same(half, other)
            last, keep_other = len(middle) - (len(half) - u), u
        if agreed and first <= last:
            return before + after, np.concatenate([own[:keep_own], middle[first:last], other[keep_other:]])
        size *= 2


def tree(nodes: list[tuple[str, np.ndarray]], model: WordEncoder, window: int = WINDOW, margin: int = MARGIN) -> tuple[str, np.ndarray]:
    """The nodes, in order, joined pair by pair to one."""
    while len(nodes) > 1:
        pairs = [joined(*nodes[i : i + 2], model, window, margin) for i in range(0, len(nodes) - 1, 2)]
        nodes = pairs + nodes[len(nodes) - len(nodes) % 2 :]
    return nodes[0]


def leaves(text: str, model: WordEncoder, size: int) -> Iterator[str]:
    """The text in leaves of ``size`` characters, or a little more where it can't be cut."""
    at = 0
    while at < len(text):
        end = model.cut(text, at + size) if at + size < len(text) else len(text)
        yield text[at:end]
        at = end


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", out: str = "ids", leaf: int = LEAF, window: int = WINDOW) -> DataFrame:
    """``docs`` with a binary column ``out`` of ids in place of the text."""
    rest = [c for c in docs.columns if c != text_col and c.lower() != out.lower()]
    key, no, text = fresh([*docs.columns, out], "__key", "__no", "__text")
    base = docs.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text))
    schema = type(base.schema)([f for f in base.schema.fields if f.name != text]).add(out, "binary")
    size = F.length(text)

    def short(batches):
        model = word_encoder(tokenizer)
        for part in slices(batches, text):
            raw = part.column(len(rest)).cast(pa.binary()).to_pylist()
            yield appended(part.select(rest), **{out: pa.array(model.texts(raw), pa.binary())})

    direct = base.filter(size <= leaf).mapInArrow(short, schema)
    # The numbers of rows are written with them, so that every reader has the same ones, however the rows came.
    long = written(base.filter(size > leaf).withColumn(key, F.monotonically_increasing_id()), "long")
    longest = long.agg(F.max(size)).first()[0] or 0

    def cut(batches):
        model = word_encoder(tokenizer)
        for part in slices(batches, text):
            for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for n, own in enumerate(leaves(t, model, leaf)):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([n], pa.int64()), pa.array([own])], names=[key, no, text])

    def encoded(batches):
        model = word_encoder(tokenizer)
        for part in slices(batches, text):
            yield appended(part, **{out: pa.array(model.texts(part.column(2).cast(pa.binary()).to_pylist()), pa.binary())})

    def join(batches):
        """FAN neighbours, which come one after the other, as one node."""
        model, at, held = word_encoder(tokenizer), None, []

        def node():
            whole, ids = tree(held, model, window)
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([whole]), pa.array([ids.tobytes()], pa.binary())], names=[key, no, text, out])

        for part in slices(batches, text, FAN):
            for k, n, t, ids in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if held and at != (k, n // FAN):
                    yield node()
                    held = []
                at = k, n // FAN
                held.append((t, np.frombuffer(ids, "<u4")))
        if held:
            yield node()

    nodes = long.select(key, text).mapInArrow(cut, f"{key} long, {no} long, {text} string").repartition(key, no)
    shape = f"{key} long, {no} long, {text} string, {out} binary"
    nodes = nodes.mapInArrow(encoded, shape)
    most = math.ceil(longest / leaf)
    while most > 1:
        most = math.ceil(most / FAN)
        nodes = nodes.withColumn("of", F.expr(f"{no} div {FAN}")).repartition(key, "of").drop("of").sortWithinPartitions(key, no).mapInArrow(join, shape)
    return direct.unionByName(long.drop(text).join(nodes.select(key, out), key).drop(key))


def decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with a string column ``out``: the tokens of the ids with a blank between them, as of a tokenizer file without decoder. Null ids give null."""
    schema = type(rows.schema)([*rows.schema.fields]).add(out, "string")

    def run(batches):
        table = token_texts(tokenizer).__getitem__
        for part in slices(batches, ids_col):
            own = part.column(part.schema.get_field_index(ids_col)).to_pylist()
            texts = [None if x is None else b" ".join(map(table, np.frombuffer(x, "<u4").tolist())) for x in own]
            yield appended(part, **{out: pa.array(texts, pa.binary()).cast(pa.string())})

    return rows.mapInArrow(run, schema)

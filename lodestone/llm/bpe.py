"""Byte-level BPE by overlapping chunks.

Texts longer than a chunk are cut into chunks that overlap. Chunks are
pre-tokenised and encoded in parallel; neighbours are stitched at the first
pre-token boundary that both have in their overlap. From a position on, matches
depend on what follows only, so both agree from a common boundary on; boundaries
within MARGIN of a chunk's end, where the pattern looks past it, don't count.
Where an overlap has no common boundary (a pre-token longer than it), the two
chunks are joined and matched anew. Decoding joins the ids' bytes.

Null texts count as empty, with no ids. All other columns are kept, repeated
rows too; ids come in ``out`` as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import appended, mapped, slices
from .common import fresh, written
from .tokens import PieceEncoder

#: Characters in a chunk, and those that it shares with the next.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Pieces that a worker remembers at least, and twice as many at most.
KEPT = 150_000
#: The pattern looks at so many characters past a match at most. Patterns that look further need more, see ``margin``.
MARGIN = 4


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file; opened on the machine that uses it."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def rank_encoder(path: str, pattern: str) -> PieceEncoder:
    """Encodes each match of ``pattern`` by itself. It lives as long as its task: workers that kept it would hold that memory through all later stages."""
    import tiktoken

    model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    return PieceEncoder(model._encode_single_piece, regex.compile(pattern).findall, KEPT)


def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each id."""
    return {i: b for b, i in load_ranks(path).items()}


def chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(start, text) of the chunks; the last ends with the text."""
    for at in range(0, max(1, len(text)), size):
        yield at, text[at : at + size + overlap]
        if at + size + overlap >= len(text):
            return


def boundaries(text: str, pattern) -> list[int]:
    """Where each pre-token starts, and the end."""
    out = [0]
    for m in pattern.finditer(text):
        out.append(m.end())
    return out


def stitched(parts: Iterator[tuple[int, str, list[int]]], pattern, margin: int = MARGIN) -> Iterator[tuple[str, list[int]]]:
    """(text, boundaries) of consecutive stretches that end at true boundaries.

    ``parts``: (start, chunk, boundaries in it) of one text, in order. Two chunks are held at a time.
    """
    held = None
    for start, text, marks in parts:
        if held is None:
            held = start, text, marks
            continue
        at, before, own = held
        end = at + len(before) - margin
        own_set = {at + x for x in own if start <= at + x <= end}
        common = next((x for x in marks if start + x in own_set), None)
        if common is None:  # no pre-token ends in the overlap
            joined = before + text[at + len(before) - start :]
            held = at, joined, boundaries(joined, pattern)
            continue
        cut = start + common - at
        yield before[:cut], own[: bisect.bisect_right(own, cut)]
        held = start + common, text[common:], [x - common for x in marks if x >= common]
    if held is not None:
        yield held[1], held[2]


def encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", out: str = "ids", size: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> DataFrame:
    """``docs`` with a binary column ``out`` of ids in place of the text. An own column of that name gives way to it.

    ``pattern`` must not look behind a match, nor more than ``margin`` characters past it, and its matches must cover the text.
    """
    rest = [c for c in docs.columns if c != text_col and c.lower() != out.lower()]
    key, no, start, marks, text = fresh([*docs.columns, out], "__key", "__no", "__start", "__marks", "__text")
    base = docs.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text))
    fields = [f for f in base.schema.fields if f.name != text]
    schema = type(base.schema)([*fields]).add(out, "binary")

    def short(batches):
        model = rank_encoder(ranks, pattern)
        for part in slices(batches, text):
            yield appended(part.select(rest), **{out: pa.array(model(part.column(len(rest)).to_pylist()), pa.binary())})

    direct = mapped(base.filter(F.length(text) <= size + overlap), short, schema)
    # The numbers of rows are written with them, so that every reader has the same ones, however the rows came.
    long = written(base.filter(F.length(text) > size + overlap).withColumn(key, F.monotonically_increasing_id()), "long")
    texts = long.select(key, text)

    def cut(batches):
        for part in slices(batches, text):
            for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for n, (at, chunk) in enumerate(chunks(t, size, overlap)):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([n], pa.int32()), pa.array([at], pa.int64()), pa.array([chunk])], names=[key, no, start, text])

    def split(batches):
        compiled = regex.compile(pattern)
        for part in slices(batches, text):
            yield appended(part, **{marks: pa.array([boundaries(t, compiled) for t in part.column(3).to_pylist()], pa.list_(pa.int32()))})

    pieces = mapped(texts, cut, f"{key} long, {no} int, {start} long, {text} string").repartition(key, no)
    pieces = mapped(pieces, split, f"{key} long, {no} int, {start} long, {text} string, {marks} array<int>")

    def stitch(batches):
        """Stretches of each text, in order: what is encoded next, again in parallel."""
        compiled = regex.compile(pattern)

        def rows():
            for part in slices(batches, text):
                yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        def one(first, source, rest):
            yield first[2], first[3], first[4]
            for r in source:
                if r[0] != first[0]:
                    rest.append(r)
                    return
                yield r[2], r[3], r[4]

        source = rows()
        following = [r] if (r := next(source, None)) is not None else []
        while following:
            first = following.pop()
            for n, (t, own) in enumerate(stitched(one(first, source, following), compiled, margin)):
                yield pa.RecordBatch.from_arrays([pa.array([first[0]], pa.int64()), pa.array([n], pa.int32()), pa.array([t]), pa.array([own], pa.list_(pa.int32()))], names=[key, no, text, marks])

    stretches = mapped(pieces.repartition(key).sortWithinPartitions(key, no), stitch, f"{key} long, {no} int, {text} string, {marks} array<int>")

    def merge(batches):
        model = rank_encoder(ranks, pattern)
        cut = lambda x: [x[0][a:b] for a, b in zip(x[1], x[1][1:])]  # noqa: B905, E731
        for part in slices(batches, text):
            ids = model(list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)), cut)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary())], names=[key, no, out])

    coded = mapped(stretches.repartition(key, no), merge, f"{key} long, {no} int, {out} binary")

    def join(batches):
        """The stretches of a text, in order, as one row; a row was one before, too."""
        k, held = None, []
        for part in slices(batches, out):
            for a, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                if held and a != k:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=[key, out])
                    held = []
                k = a
                held.append(ids)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=[key, out])

    joined = mapped(coded.repartition(key).sortWithinPartitions(key, no), join, f"{key} long, {out} binary")
    whole = long.drop(text).join(joined, key).drop(key)
    return direct.unionByName(whole)


def decode(rows: DataFrame, ranks: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with a binary column ``out``: the bytes of the ids, joined."""
    schema = type(rows.schema)([*rows.schema.fields]).add(out, "binary")

    def run(batches):
        table = token_bytes(ranks).__getitem__
        for part in slices(batches, ids_col):
            own = part.column(part.schema.get_field_index(ids_col)).to_pylist()
            yield appended(part, **{out: pa.array([None if x is None else b"".join(map(table, np.frombuffer(x, "<u4").tolist())) for x in own], pa.binary())})

    return mapped(rows, run, schema)

"""Token ids of documents in fixed-width bit-packed files.

A file holds the ids of a range of documents, each id in the least bits that the
vocabulary needs. Blocks of a fixed number of ids start at byte offsets that the
file's tail lists, so that numpy unpacks whole blocks, and any range of ids can
be read by itself:

    blocks | block offsets u64 | document ids i64 | nulls u8 | document ends u64 | tail

Files are in ascending order of document id. Equal ids are ordered by a hash of
the text, then the text; null ids come first. Null texts count as empty: their
document is the end id alone. An empty table gives no file and no row.
"""

from __future__ import annotations

import functools
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import slices
from .common import file_system, new_path, put_file

#: Ids in a block.
BLOCK = 8192
#: Blocks that a reader holds at once.
GROUP = 64
_TAIL = struct.Struct("<QQQIB6s")
_MAGIC = b"LTOK1\0"

#: Pieces that a worker remembers at least, and twice as many at most; bytes of the longest of them; pieces that go to the library at once.
REMEMBERED, SHORT, AT_ONCE = 400_000, 48, 4096
#: Rows that are encoded together at most, and bytes that are cut into pieces at once, but for a longer piece.
ROWS, WINDOW = 4096, 2 << 20
#: Kinds of bytes: 0 for what may be anything, then white space, letters, digits, signs, and the apostrophe.
_KIND = np.zeros(256, dtype=np.uint8)
for _k, _own in enumerate((b"\t\n\x0b\x0c\r ", bytes(range(65, 91)) + bytes(range(97, 123)), b"0123456789", bytes(x for x in range(33, 127) if not chr(x).isalnum()), b"'"), 1):
    _KIND[list(_own)] = _k
#: By 8 x kind + the next byte's kind: whether a pre-token always ends between them.
_ENDS = np.zeros(64, dtype=bool)
_ENDS[[8 * a + b for a, b in ((0, 1), (2, 1), (3, 1), (4, 1), (5, 1), (2, 3), (2, 4), (2, 5), (3, 2), (3, 4), (3, 5), (4, 2), (4, 3), (5, 3))]] = True


def little(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Remembered:
    """Ids of pieces as little-endian bytes; those of short pieces met of late are kept."""

    def __init__(self, encode: Callable[[list], Iterable], most: int = REMEMBERED):
        self.encode, self.most, self.known, self.older = encode, most, {}, {}

    def __call__(self, pieces: list) -> list[bytes]:
        """The ids of each of the distinct pieces."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = list(map(known.get, pieces))
        gaps = [i for i, ids in enumerate(out) if ids is None]
        for a in range(0, len(gaps), AT_ONCE):
            own, new = gaps[a : a + AT_ONCE], []
            for i in own:
                out[i] = older.get(pieces[i])
                if out[i] is None:
                    new.append(i)
            for i, ids in zip(new, self.encode([pieces[i] for i in new]), strict=True):
                out[i] = ids
            known.update((pieces[i], out[i]) for i in own if len(pieces[i]) <= SHORT)
        return out


class PieceEncoder:
    """Ids of texts, piece by piece."""

    def __init__(self, encode: Callable[[str], list[int]], split: Callable[[str], list[str]], most: int = REMEMBERED):
        self.ids, self.split = Remembered(lambda pieces: [little(encode(p)) for p in pieces], most), split

    def __call__(self, texts: list, split: Callable | None = None) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; ``split`` cuts texts in place of the encoder's own function."""
        parts = [(split or self.split)(t) for t in texts]
        pieces = list({x for p in parts for x in p})
        get = dict(zip(pieces, self.ids(pieces), strict=True)).__getitem__
        return [b"".join(map(get, p)) for p in parts]


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if it shows in print, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def piece_starts(raw: np.ndarray, low: int, high: int, closed: np.ndarray) -> np.ndarray:
    """Places in ``raw`` between ``low`` and ``high`` where a pre-token always begins and what goes before doesn't matter.

    ``closed`` are the ends of stretches, which are such places, too. By the byte-level pattern these are: white space after something else; changes
    between letters, digits and signs in ASCII, but for letters after an apostrophe; and, where an ASCII character that is
    no white space follows, the last of several white spaces, and what comes after white space other than a blank.
    """
    kind = _KIND[raw[low : high + 1]]
    if high == len(raw):
        kind = np.append(kind, np.uint8(0))
    before, here, after = kind[:-2], kind[1:-1], kind[2:]
    found = _ENDS[before * np.uint8(8) + here]
    plain = here > 1
    found |= (before == 1) & plain & (raw[low : low + len(before)] != 32)
    last = (before == 1) & (here == 1) & (after > 1)
    last[closed[(closed > low + 1) & (closed <= high)] - low - 2] = False
    found |= last
    # Bytes from 128 on may end a white space: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
    at = np.flatnonzero(found & (before == 0)) + low
    if len(at):
        end, two, three = raw[at], raw[np.maximum(at - 1, 0)], raw[np.maximum(at - 2, 0)]
        found[at[(end >= 128) & ((two == 0xC2) | (three >= 0xE1) & (three <= 0xE3) & ((two == 0x9A) | (two == 0x80) | (two == 0x81)))] - low] = False
    found[closed[(closed > low) & (closed < high)] - low - 1] = True
    return np.flatnonzero(found) + low + 1


class LibraryEncoder:
    """Ids of Arrow columns of texts, as the tokenizers library gives them for a byte-level BPE without normalizer.

    Texts are cut at their special tokens, as the library does, and these stretches where pre-tokens always end. Distinct
    pieces are found by Arrow's hash table and encoded by the library; numpy puts their ids together.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        added = list(model.get_added_tokens_decoder().values())
        if model.normalizer is not None or any(t.single_word or t.lstrip or t.rstrip for t in added):
            raise ValueError(f"{path} does more than a byte-level BPE with plain special tokens")
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in sorted(added, key=lambda t: -len(t.content)))) if added else None

        special = {t.content.encode() for t in added}
        # These are one pre-token each, so they go to the library's merges at once.
        one = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|[\t\n\r ]").fullmatch
        letters, merges = byte_letters(), model.model.tokenize

        def encode(pieces):
            out: list = [little([t.id for t in merges(p.decode("latin-1").translate(letters))]) if one(p) and p not in special else None for p in pieces]
            rest = [i for i, ids in enumerate(out) if ids is None]
            for i, e in zip(rest, model.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False), strict=True):
                out[i] = little(e.ids)
            return out

        self.ids = Remembered(encode)

    def __call__(self, column: pa.Array) -> list[bytes]:
        """The ids of each text (null: none) as little-endian unsigned 32-bit integers."""
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        data = b"".join(x.as_buffer() for x in column if x.is_valid)
        raw, own = np.frombuffer(data, np.uint8), self._special(data, ends)
        closed = np.union1d(ends, own.ravel())
        out: list[list[bytes]] = [[] for _ in ends]
        low, size = 0, WINDOW
        while low < len(raw):
            high = min(len(raw), low + size)
            starts = piece_starts(raw, low, high, closed)
            if len(own):
                k = np.searchsorted(own[:, 0], starts, side="left") - 1
                starts = starts[(k < 0) | (starts >= own[np.maximum(k, 0), 1])]
            if high < len(raw):
                if not len(starts):
                    size *= 2
                    continue
                high, starts = int(starts[-1]), starts[:-1]
            self._add(data, np.r_[low, starts, high], ends, out)
            low, size = high, WINDOW
        return [b"".join(x) for x in out]

    def _special(self, data: bytes, ends: np.ndarray) -> np.ndarray:
        """(start, end) of the special tokens in the texts."""
        if self.special is None or not self.special.search(data):
            return np.empty((0, 2), np.int64)
        found = [m.span() for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True) for m in self.special.finditer(data, a, b)]
        return np.array(found, dtype=np.int64).reshape(-1, 2)

    def _add(self, data: bytes, cuts: np.ndarray, ends: np.ndarray, out: list[list[bytes]]) -> None:
        """Append the ids of the pieces between ``cuts`` to their texts' lists."""
        base = int(cuts[0])
        part = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts - base).astype(np.int32)), pa.py_buffer(memoryview(data)[base : int(cuts[-1])])]).dictionary_encode()
        each, place = self.ids(part.dictionary.to_pylist()), part.indices.to_numpy()
        n = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat, first = np.frombuffer(b"".join(each), "<u4"), np.cumsum(n) - n
        many = n[place]
        upto = np.r_[0, np.cumsum(many)]
        ids = flat[np.arange(upto[-1]) + np.repeat(first[place] - upto[:-1], many)]
        # Texts that these pieces belong to, and where each of them ends.
        i = int(np.searchsorted(ends, base, side="right"))
        a = 0
        while i < len(ends) and a < len(cuts) - 1:
            b = int(np.searchsorted(cuts, ends[i], side="left")) if ends[i] <= cuts[-1] else len(cuts) - 1
            out[i].append(ids[upto[a] : upto[b]].tobytes())
            a = b
            i += 1


@functools.cache
def library_encoder(path: str) -> LibraryEncoder:
    """The encoder for a tokenizer file; a worker process keeps it from task to task."""
    return LibraryEncoder(path)


def width(vocabulary: int) -> int:
    """The least bits for ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each, highest bit first, filled up to whole bytes. An id that needs more bits is an error."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {ids.max()} needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype(">u4").view(np.uint8)).reshape(-1, 32)[:, 32 - bits :]
    return np.packbits(spread).tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    spread = np.zeros((n, 32), dtype=np.uint8)
    spread[:, 32 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(spread).view(">u4").astype(np.uint32)


def file_parts(documents: Iterable[tuple[int | None, bytes]], bits: int, totals: dict, block: int = BLOCK) -> Iterator[bytes]:
    """The bytes of a file from (document id, ids as little-endian u4). ``totals`` gets ids and docs."""
    held, count, offsets, at, names, ends = [], 0, [], 0, [], []
    total = 0

    def full(last: bool = False) -> Iterator[bytes]:
        nonlocal held, count, at
        ids, n = np.frombuffer(b"".join(held), "<u4"), 0
        while n + block <= len(ids) or last and n < len(ids):
            data = pack(ids[n : n + block], bits)
            offsets.append(at)
            at += len(data)
            n += block
            yield data
        held, count = [ids[n:].tobytes()], max(0, len(ids) - n)

    for name, ids in documents:
        held.append(ids)
        count += len(ids) // 4
        total += len(ids) // 4
        names.append(name)
        ends.append(total)
        if count >= block * GROUP:
            yield from full()
    yield from full(last=True)
    yield np.array(offsets, "<u8").tobytes()
    yield np.array([n or 0 for n in names], "<i8").tobytes()
    yield np.array([n is None for n in names], np.uint8).tobytes()
    yield np.array(ends, "<u8").tobytes()
    yield _TAIL.pack(total, len(names), len(offsets), block, bits, _MAGIC)
    totals |= {"ids": total, "docs": len(names)}


class TokenFile:
    """Random access to a file by its URI."""

    def __init__(self, uri: str):
        filesystem, path = file_system(uri)
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        self.ids, docs, blocks, self.block, self.bits, magic = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        if magic != _MAGIC:
            raise ValueError(f"{uri} is no token file")
        tail = size - _TAIL.size - 8 * blocks - 17 * docs
        data = self.file.read_at(8 * blocks + 17 * docs, tail)
        self.offsets = np.append(np.frombuffer(data, "<u8", blocks), np.uint64(tail)).astype(np.int64)
        names, null = np.frombuffer(data, "<i8", docs, 8 * blocks), np.frombuffer(data, np.uint8, docs, 8 * (blocks + docs))
        self.names = [None if z else int(n) for n, z in zip(names, null, strict=True)]
        self.ends = np.frombuffer(data, "<u8", docs, 8 * blocks + 9 * docs).astype(np.int64)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to ``stop``, of the blocks that hold them only."""
        stop = min(stop, self.ids)
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        begin = int(self.offsets[first])
        data = self.file.read_at(int(self.offsets[last + 1]) - begin, begin)
        # All blocks but a file's last are full.
        parts = [unpack(data[int(self.offsets[b]) - begin : int(self.offsets[b + 1]) - begin], self.bits, min(self.block, self.ids - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(document id, first id's place, ids, crc32) in order, with GROUP blocks at a time in memory."""
        window, base, limit, start = np.empty(0, "<u4"), 0, 0, 0
        for name, end in zip(self.names, self.ends.tolist(), strict=True):
            crc, at = 0, start
            while at < end:
                if at >= limit:
                    base, limit = at // self.block * self.block, min(self.ids, (at // self.block + GROUP) * self.block)
                    window = self.read(base, limit).astype("<u4")
                stop = min(end, limit)
                crc = zlib.crc32(window[at - base : stop - base].tobytes(), crc)
                at = stop
            yield name, start, end - start, crc
            start = end


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, block: int = BLOCK) -> tuple[str, list[tuple[str, int, int, int]]]:
    """Encode, and write one file for each range of documents.

    Returns the folder and, in order, (URI, place of the first id in the corpus, ids, documents) of each file: one entry
    for each partition, which is all that comes to the driver.
    """
    spark = docs.sparkSession
    folder, bits = folder or new_path(spark, "tokens"), width(vocabulary)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text")
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        encode, totals = library_encoder(tokenizer), {}

        def documents():
            for part in slices(batches, "text", ROWS):
                for name, ids in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                    yield name, ids + end

        k = TaskContext.get().partitionId()
        rest = documents()
        if (first := next(rest, None)) is None:
            return
        uri = f"{folder}/part-{k:06d}.ltok"

        def whole():
            yield first
            yield from rest

        put_file(uri, file_parts(whole(), bits, totals, block))
        yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "uri": [uri], "ids": pa.array([totals["ids"]], pa.int64()), "docs": pa.array([totals["docs"]], pa.int64())})

    files, start = [], 0
    for r in sorted(rows.mapInArrow(write, "k int, uri string, ids long, docs long").collect()):
        files.append((r["uri"], start, r["ids"], r["docs"]))
        start += r["ids"]
    return folder, files


def read_tokens(spark: SparkSession, files: list[tuple[str, int, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(TokenFile(uri).documents())
                names, at, n, crc = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.array(at) + start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(files, "uri string, start long, ids long, docs long")
    return table.repartition(max(1, min(len(files), 20_000))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

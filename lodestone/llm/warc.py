"""WARC archives of pages, with a two-level capture index.

Records are gzip members of their own. Of equal payloads of at least LEAST
bytes, the row with the largest id is a response record and the others revisit
it. The index has a line for each capture, sorted by reversed-host URL key, in
gzip blocks; each index file ends with a sparse directory of its blocks' first
keys, and a list of first keys by file is all that the driver sees. A look-up
searches the list, a directory and a block by halving before it reads ranges.

Defined cases: null payloads are empty; null URLs have the key ``-`` and the
target ``urn:page:ID``; rows with equal ids and payloads are all responses (or
all revisits); a null id never is the largest; empty tables give no files.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import slices
from .common import file_system, new_path, put_file, written

#: The least payload, in bytes, that is worth a revisit record.
LEAST = 1000
#: Lines in an index block.
LINES = 1000
#: Gzip's level, and the stretch of an archive that one task reads.
LEVEL, STRETCH = 5, 64 << 20
#: Digests of repeated payloads that are broadcast at most; each is 20 bytes in hex and an id. More are joined by a shuffle.
BROADCAST = 100_000
#: Bytes between wanted records that are read along rather than skipped by a new request.
GAP = 64 << 10
DATE = "1970-01-01T00:00:00Z"
_TAIL = "<QQ6s"
_MAGIC = b"LCDX1\0"


def url_key(url: str | None) -> str:
    """The URL with its host's labels reversed, without scheme, user and fragment, and free of white space."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(key, safe="%/:=&?~#+!$,;'@()*[]")


def record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, date: str = DATE) -> bytes:
    """A WARC record. A revisit has no block; its payload's length and digest stand in the head."""
    name = f"urn:page:{'null' if page is None else page}"
    target = re.sub(r"[\x00-\x20\x7f-\U0010ffff]", lambda m: quote(m[0]), url) if url else name
    block = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(head fields, block) of an unpacked record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if len(rest) != size + 4:
        raise ValueError("a record is cut off")
    return fields, rest[:size]


def marked(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """(page, url, payload, digest, refers): the row that each row revisits, null for responses.

    Ids of responses come from a grouped maximum, which is summed up before it is shuffled. Payloads stay where they are, unless
    there are too many repeated digests to broadcast; then Spark splits hot digests in the join.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    copied = rows.filter(large).groupBy("digest").agg(F.max("page").alias("best"), F.count("*").alias("n")).filter("n > 1").select("digest", "best", F.lit(True).alias("large"))
    copied = written(copied, "copied")
    few = copied.count() <= BROADCAST
    joined = rows.withColumn("large", large).join(F.broadcast(copied) if few else copied, ["digest", "large"], "left")
    return joined.select("page", "url", "payload", "digest", F.when(~F.coalesce(F.col("page") == F.col("best"), F.lit(False)), F.col("best")).alias("refers"))


def write_archives(rows: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Write :func:`marked` rows, one archive for each task; (key, page, uri, offset, length) of each capture, as a written table."""

    def run(batches):
        uri, found, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", [], 0

        def members():
            nonlocal at
            for part in slices(batches, "payload"):
                for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    data = gzip.compress(record("response" if refers is None else "revisit", page, url, payload, digest, refers, date), LEVEL, mtime=0)
                    found.append((url_key(url), page, at, len(data)))
                    at += len(data)
                    yield data

        source = members()
        if (first := next(source, None)) is None:
            return

        def whole():
            yield first
            yield from source

        put_file(uri, whole())
        for i in range(0, len(found), 10_000):
            key, page, offset, length = zip(*found[i : i + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(page, pa.int64()), pa.array([uri] * len(key)), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["key", "page", "uri", "offset", "length"])

    return written(rows.mapInArrow(run, "key string, page long, uri string, offset long, length long"), "captures")


def write_index(captures: DataFrame, folder: str, lines: int = LINES) -> list[tuple[str, str, int]]:
    """Write the sorted index, a file for each range of keys. In order, (first key, URI, blocks) of each file."""
    rows = captures.select("key", "page", "uri", "offset", "length").repartitionByRange("key", "uri", "offset").sortWithinPartitions("key", "uri", "offset")

    def run(batches):
        uri, directory, at, first = f"{folder}/{uuid.uuid4().hex}.cdx", [], 0, None

        def entries():
            for part in slices(batches, "key"):
                yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        def block(held):
            nonlocal at
            data = zlib.compress("\n".join(f"{k} {json.dumps([page, file, offset, length])}" for k, page, file, offset, length in held).encode(), LEVEL)
            directory.append((held[0][0], at, len(data)))
            at += len(data)
            return data

        source = entries()
        if (start := next(source, None)) is None:
            return

        def whole():
            held = [start]
            for x in source:
                if len(held) >= lines:
                    yield block(held)
                    held = []
                held.append(x)
            yield block(held)
            tail = zlib.compress("\n".join(f"{k} {a} {n}" for k, a, n in directory).encode(), LEVEL)
            yield tail
            yield struct.pack(_TAIL, at, len(tail), _MAGIC)

        first = start[0]
        put_file(uri, whole())
        yield pa.RecordBatch.from_pydict({"key": [first], "uri": [uri], "blocks": pa.array([len(directory)], pa.int64())})

    return sorted(tuple(r) for r in rows.mapInArrow(run, "key string, uri string, blocks long").collect())


class IndexFile:
    """An index file: its directory of blocks is read when it is opened."""

    def __init__(self, uri: str):
        filesystem, path = file_system(uri)
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        at, n, magic = struct.unpack(_TAIL, self.file.read_at(struct.calcsize(_TAIL), size - struct.calcsize(_TAIL)))
        if magic != _MAGIC:
            raise ValueError(f"{uri} is no index file")
        entries = [x.split(" ") for x in zlib.decompress(self.file.read_at(n, at)).decode().split("\n")]
        self.keys, self.places = [x[0] for x in entries], [(int(x[1]), int(x[2])) for x in entries]

    def block(self, i: int) -> list[tuple[str, list]]:
        at, n = self.places[i]
        return [(k, json.loads(rest)) for k, _, rest in (x.partition(" ") for x in zlib.decompress(self.file.read_at(n, at)).decode().split("\n"))]

    def find(self, key: str) -> Iterator[list]:
        """[page, uri, offset, length] of the captures with this key."""
        for i in range(max(0, bisect.bisect_left(self.keys, key) - 1), len(self.keys)):
            if self.keys[i] > key:
                return
            lines = self.block(i)
            for k, x in lines[bisect.bisect_left(lines, key, key=lambda y: y[0]) :]:
                if k != key:
                    return
                yield x


def lookup(files: list[tuple[str, str, int]], url: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a URL: (head fields, block)."""
    key, starts = url_key(url), [x[0] for x in files]
    for i in range(max(0, bisect.bisect_left(starts, key) - 1), len(files)):
        if starts[i] > key:
            return
        for _, uri, offset, length in IndexFile(files[i][1]).find(key):
            filesystem, path = file_system(uri)
            with filesystem.open_input_file(path) as archive:
                yield parse_record(gzip.decompress(archive.read_at(length, offset)))


def read_archives(spark: SparkSession, files: list[tuple[str, str, int]], lines_a_task: int = 200 * LINES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every capture in the index.

    Blocks of the index give ranges of the archives; tasks read stretches of an archive, in order. Digests of responses are taken from what was read.
    """
    spans = [(uri, a, min(n, a + max(1, lines_a_task // LINES))) for _, uri, n in files for a in range(0, n, max(1, lines_a_task // LINES))]

    def places(batches):
        for batch in batches:
            for uri, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index = IndexFile(uri)
                for i in range(a, b):
                    _, file, offset, length = zip(*(x for _, x in index.block(i)), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(file), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["uri", "offset", "length"])

    def records(batches):
        open_uri, archive, data, base = None, None, b"", 0
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            out = []
            for i, (uri, offset, length) in enumerate(rows):
                if uri != open_uri:
                    filesystem, path = file_system(uri)
                    open_uri, archive, data, base = uri, filesystem.open_input_file(path), b"", 0
                if not base <= offset <= offset + length <= base + len(data):
                    stop = offset + length
                    for u, o, n in rows[i + 1 : i + 500]:
                        if u != uri or o - stop > GAP or o < offset or o + n - offset > 4 << 20:
                            break
                        stop = max(stop, o + n)
                    data, base = archive.read_at(stop - offset, offset), offset
                head, payload = parse_record(zlib.decompress(memoryview(data)[offset - base : offset - base + length], 31))
                page, kind = head["WARC-Record-ID"][10:-1], head["WARC-Type"]
                digest = hashlib.sha1(payload).hexdigest() if kind == "response" else head["WARC-Payload-Digest"][5:]
                refers = int(head["WARC-Refers-To"][10:-1]) if kind == "revisit" else None
                out.append((None if page == "null" else int(page), len(payload) if kind == "response" else int(head["WARC-Payload-Length"]), digest, kind, refers))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    table = spark.createDataFrame(spans, "uri string, first long, last long").repartition(max(1, min(len(spans), 20_000)))
    wanted = table.mapInArrow(places, "uri string, offset long, length long")
    stretch = F.floor(F.col("offset") / STRETCH)
    ordered = wanted.repartition("uri", stretch).sortWithinPartitions("uri", "offset")
    return ordered.mapInArrow(records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> list[tuple[str, str, int]]:
    """Write the archives and the index of a table; the list of index files."""
    folder = new_path(pages.sparkSession, "warc")
    return write_index(write_archives(marked(pages, id_col, url_col, payload_col, least), folder), folder)

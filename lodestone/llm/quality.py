"""Quality classification by co-training two views.

One classifier sees the text's content (shares of character classes and of their
pairs, words, repetition), the other the page's metadata (source, language,
length). In each round both are fitted, and each hands the rows that it is surest
of, with its label, to the other. Both are then calibrated on labelled rows that
neither was fitted on, and a logistic regression of the two calibrated scores,
fitted on those, too, scores all documents.

Fitting takes at most about LABELLED labelled rows and POOL unlabelled ones,
chosen by a hash of the document's id and text; rows that repeat both count once,
and only features come to the driver. Scoring takes all rows and whole texts.

Defined cases: null texts count as empty; an id with several labels counts as
good from a mean of a half on; null labels are none. Without labels of both kinds
every document has quality 1. Own columns with the names of the new ones give way
to them. Equal scores are handed over in order of id. Rows stay as they are, repeated ones too; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import appended, mapped, own_text, slices
from .common import fresh

#: Labelled and unlabelled rows for fitting, as expected; rounds; rows of each label that a view hands over in a round; how sure it must be.
LABELLED, POOL, ROUNDS, HANDED, SURE = 8_000, 8_000, 3, 400, 0.95
#: Documents of less quality are rejected.
KEEP = 0.5
#: One labelled row in FOLD is kept for calibration.
FOLD = 4

# Character classes (fixed values).
_CLASS = np.full(256, 9, dtype=np.int64)
for _k, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\t\n\r\x0b\x0c", ".,;:", "!?", "'\"()-", "|/\\_<>[]{}"]):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[0x80:] = 10
CLASSES = 11
#: Bytes whose classes are counted at once.
PIECE = 1 << 20
TEXT, META = CLASSES + CLASSES**2 + 7, 64


def text_features(text: str) -> np.ndarray:
    """The text view of a document."""
    raw, pairs = np.frombuffer(text.encode(), np.uint8), np.zeros(CLASSES**2)
    single = np.zeros(CLASSES)
    for a in range(0, len(raw), PIECE):
        c = _CLASS[raw[a : a + PIECE + 1]]
        single += np.bincount(c[:PIECE], minlength=CLASSES)
        pairs += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES**2)
    words, lines = text.split(), text.split("\n")
    n, m = max(1, len(words)), max(1, len(lines))
    rest = [math.log1p(len(words)), len(text) / n, len(set(words)) / n, len(set(lines)) / m, n / m / 50, sum(w.isupper() for w in words) / n, sum(w[-1].isalpha() for w in words) / n]
    return np.concatenate([np.sqrt(single / max(1, len(raw))), np.sqrt(pairs / max(1, len(raw))), rest]).astype(np.float32)


def meta_features(source: str | None, lang: str | None, chars: int | None) -> np.ndarray:
    """The metadata view of a document."""
    out = np.zeros(META, dtype=np.float32)
    out[zlib.crc32(f"s{source}".encode()) % 32] = 1
    out[32 + zlib.crc32(f"l{lang}".encode()) % 15] = 1
    size = math.log2(1 + max(0, chars or 0))
    out[47 + min(15, int(size))] = 1
    out[63] = size / 10
    return out


class Logistic:
    """Ridge logistic regression on standardised columns, by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 12):
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = np.c_[self._z(x), np.ones(len(x))]
        w, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (p - y) + penalty * w
            w = w - np.clip(np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), slope), -5, 5)
        self.w = w

    def _z(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._z(x) @ self.w[:-1] + self.w[-1], -30, 30)


class CoTrained:
    """Two views, their calibrations and how they are put together. Without rows of both labels it says 1 to all."""

    def __init__(self, a: np.ndarray, b: np.ndarray, y: np.ndarray, fold: np.ndarray, pool_a: np.ndarray, pool_b: np.ndarray, rounds: int = ROUNDS):
        self.views = None
        held = fold == 0
        if any(len(set(y[rows].tolist())) < 2 for rows in (held, ~held)):
            return
        views, sets = [a, b], [(a[~held], y[~held]), (b[~held], y[~held])]
        pools, free = [pool_a, pool_b], np.ones(len(pool_a), dtype=bool)
        for _ in range(rounds):
            models = [Logistic(x, t) for x, t in sets]
            handed = []
            for k in (0, 1):
                p = 1 / (1 + np.exp(-models[k].logit(pools[k])))
                for label, sure in ((1, p), (0, 1 - p)):
                    at = np.nonzero(free & (sure >= SURE))[0]
                    handed.append((1 - k, label, at[np.argsort(-sure[at], kind="stable")[:HANDED]]))
            for to, label, at in handed:
                at = at[free[at]]
                sets[to] = np.concatenate([sets[to][0], pools[to][at]]), np.concatenate([sets[to][1], np.full(len(at), label)])
                free[at] = False
        self.views = [Logistic(x, t) for x, t in sets]
        self.calibrated = [Logistic(m.logit(v[held])[:, None], y[held]) for m, v in zip(self.views, views, strict=True)]
        self.joint = Logistic(self._scores(a[held], b[held]), y[held])

    def _scores(self, a, b):
        return np.stack([c.logit(m.logit(x)[:, None]) for c, m, x in zip(self.calibrated, self.views, (a, b), strict=True)], axis=1)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Columns: quality by the text, by the metadata, by both."""
        if self.views is None:
            return np.ones((len(a), 3))
        s = self._scores(a, b)
        return 1 / (1 + np.exp(-np.c_[s, self.joint.logit(s)]))


def _hashed(part, text, source, lang, chars):
    column = lambda c: part.column(part.schema.get_field_index(c)).to_pylist()
    a = np.stack([text_features(t or "") for t in column(text)])
    b = np.stack([meta_features(*x) for x in zip(column(source), column(lang), column(chars), strict=True)])
    return a, b


class _Names:
    """Columns that stand beside the documents' own."""

    def __init__(self, docs: DataFrame, out):
        self.text, self.source, self.lang, self.chars = fresh([*docs.columns, *out], "__text", "__source", "__lang", "__chars")

    def views(self):
        return self.text, self.source, self.lang, self.chars


def _with_views(docs: DataFrame, names: _Names, text_col, source_col, lang_col) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns({names.text: text, names.source: F.col(source_col).cast("string"), names.lang: F.col(lang_col).cast("string"), names.chars: F.length(text).cast("long")})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", label_col: str = "quality", labelled: int = LABELLED, pool: int = POOL) -> CoTrained:
    """A model of ``labels`` (id, 0 or 1) over the documents."""
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("double").alias("__y")).dropna().groupBy("__id").agg((F.avg("__y") >= 0.5).cast("int").alias("__y"))
    drawn = lambda seed, most, of, *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 20)) < math.ceil(min(1.0, most / max(1, of)) * (1 << 20))
    own = known.filter(drawn(21, labelled, known.count(), F.col("__id")))
    names = _Names(docs, ("__id", "__y", "__h"))
    rows = _with_views(docs, names, text_col, source_col, lang_col).select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(names.text).alias("__h"), *names.views())
    # LABELLED ids as expected, whatever the table's size: small enough to broadcast.
    mine = rows.join(F.broadcast(own), "__id")
    pairs = mine.select("__id", "__h").distinct().count()
    first = mine.filter(drawn(23, labelled, pairs, "__id", "__h"))
    others = rows.filter(drawn(22, pool, docs.count(), "__id", "__h")).join(F.broadcast(own.select("__id")), "__id", "left_anti").withColumn("__y", F.lit(-1))
    # An id and text that many rows repeat counts once, before any of it moves.
    once = lambda some: some.groupBy("__id", "__y", "__h").agg(F.min(F.struct(*names.views())).alias("__v")).select("__id", "__y", "__v.*")

    def run(batches):
        for part in slices(batches, names.text):
            a, b = _hashed(part, *names.views())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in np.c_[a, b].astype("<f4")], pa.binary())], names=["id", "y", "x"])

    # Ordered, so that a fit is the same whatever order tasks end in.
    found = sorted(((r["id"], r["y"], bytes(r["x"])) for r in mapped(once(first).unionByName(once(others)), run, "id long, y int, x binary").collect()), key=lambda r: (r[0] is not None, r))
    x = np.array([np.frombuffer(r[2], "<f4") for r in found], dtype=np.float64).reshape(len(found), TEXT + META)
    y, fold = np.array([r[1] for r in found], dtype=np.int64), np.array([zlib.crc32(str(r[0]).encode()) % FOLD for r in found], dtype=np.int64)
    is_own, is_pool = y >= 0, y < 0
    return CoTrained(x[is_own, :TEXT], x[is_own, TEXT:], y[is_own], fold[is_own], x[is_pool, :TEXT], x[is_pool, TEXT:])


def score(docs: DataFrame, model: CoTrained, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", out: tuple[str, str, str, str] = ("quality_text", "quality_meta", "quality", "kept")) -> DataFrame:
    """``docs`` with four more columns ``out``: quality by the text, by the metadata and by both, and whether the row is kept."""
    names = _Names(docs, out)
    shared, kept = docs.sparkSession.sparkContext.broadcast(model), [c for c in docs.columns if c.lower() not in {x.lower() for x in out}]
    schema = type(docs.schema)([docs.schema[c] for c in kept])
    for c in out[:3]:
        schema = schema.add(c, "double")
    schema = schema.add(out[3], "boolean")
    rows, own = _with_views(docs, names, text_col, source_col, lang_col), own_text(docs, text_col)
    if own is not None:
        rows, names.text = rows.drop(names.text), own

    def run(batches):
        for part in slices(batches, names.text):
            p = shared.value(*_hashed(part, *names.views()))
            yield appended(part.select(kept), **{c: pa.array(np.round(p[:, i], 6)) for i, c in enumerate(out[:3])}, **{out[3]: pa.array(p[:, 2] >= KEEP)})

    return mapped(rows, run, schema)

"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence meet in one posterior: likelihoods of the text's byte
trigrams, the declared (markup) language, and priors of the address's host, which
are smoothed towards its suffix's, and those towards the whole corpus's. Priors
are soft counts over all rows, summed by grouped aggregation; a row's own part is
taken out of them before it is judged.

Trigram counts are fitted on rows with a declared language, chosen by hash: SAMPLE
of all are expected, and RARE of a language or all that it has; no text comes to
the driver. Every declared language is one, however rare; tables are sparse, with
an entry for each trigram that a language has. Text that no language explains
clearly better than even chance does is OTHER, and not accepted.

Defined cases: a null or empty text, or one without letters, has no likelihood;
its posterior is that of the other evidence, and it is not accepted. Null
declared languages and addresses are no evidence. Own columns with the names of
the new ones give way to them. Without any declared language
in the table, the language is null and nothing is accepted. Rows stay as they
are, repeated ones too; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import appended, mapped, own_text, slices
from .common import fresh, written

#: Rows that trigram counts are fitted on, as expected; of a language at least, where it has them; the outcome of text that no language explains.
SAMPLE, RARE, OTHER = 20_000, 200, "other"
#: The share of chance texts that may be taken for a language.
CHANCE = 0.01
#: Cells of a table of rows by languages that a task holds at once.
CELLS = 1 << 20
#: Trigram buckets; trigrams that a text's likelihood counts as, so that long texts don't drown the rest.
BUCKETS, WEIGHT = 1 << 15, 60
#: The share of declared languages that is taken to be wrong; soft counts that a suffix has from the corpus and a host from its suffix.
WRONG, SMOOTH = 0.02, 20.0
#: The least posterior of an accepted row.
ACCEPT = 0.5
#: Bytes of priors (hosts by languages), or of languages' shares, that are broadcast at most; beyond it they are joined by a shuffle.
BROADCAST = 8 << 20
#: Bytes that are looked at at once.
PIECE = 1 << 17

_FOLD = np.full(256, 32, dtype=np.uint32)
for _lo, _hi in ((ord("a"), ord("z")), (0x80, 0xFF)):
    _FOLD[_lo : _hi + 1] = np.arange(_lo, _hi + 1)


def trigrams(texts: list[str]):
    """(bucket, place of the text) of the trigrams with a letter in the middle, some at a time."""
    raw = [f" {t} ".lower().encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    whole = np.frombuffer(b"".join(raw), np.uint8)
    for a in range(0, max(0, len(whole) - 2), PIECE):
        c = _FOLD[whole[a : a + PIECE + 2]]
        code = c[:-2] << 16 | c[1:-1] << 8 | c[2:]
        start = np.arange(a, a + len(code))
        owner = np.searchsorted(ends, start, side="right")
        ok = (c[1:-1] != 32) & (start + 2 < ends[owner])
        yield (code[ok] * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64), owner[ok]


def fit(rows: DataFrame, counts: dict[str, int], sample: int = SAMPLE) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each language of ``counts`` (rows of it), and OTHER, from (key, text, declared) rows: the log-likelihood of a trigram without a count, buckets with one, and what they have more."""
    languages, total = list(counts), sum(counts.values())
    draws = [(x, i, int(min(1.0, max(sample / total, RARE / n)) * (1 << 20))) for i, (x, n) in enumerate(counts.items())]
    drawn = rows.sparkSession.createDataFrame(draws, "declared string, l int, draw int")
    small = sum(64 + len(x.encode()) for x in languages) <= BROADCAST
    few = rows.join(F.broadcast(drawn) if small else drawn, "declared").filter(F.pmod(F.xxhash64(F.lit(11), "key"), F.lit(1 << 20)) < F.col("draw"))

    def count(batches):
        cells, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for part in slices(batches, "text"):
            own = part.column(part.schema.get_field_index("l")).to_numpy().astype(np.int64)
            for bucket, owner in trigrams(part.column(part.schema.get_field_index("text")).to_pylist()):
                new, many = np.unique(own[owner] * BUCKETS + bucket, return_counts=True)
                cells, place = np.unique(np.concatenate([cells, new]), return_inverse=True)
                n = np.bincount(place, weights=np.concatenate([n, many]), minlength=len(cells)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cells // BUCKETS, pa.int32()), pa.array(cells % BUCKETS, pa.int32()), pa.array(n, pa.int64())], names=["l", "b", "n"])

    found: list[tuple[list, list]] = [([], []) for _ in languages]
    # A row comes back for each trigram that a language has.
    for r in mapped(few.select("text", "l"), count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).collect():
        found[r["l"]][0].append(r["b"])
        found[r["l"]][1].append(r["n"])
    model = [(math.log(0.5 / (0.5 * BUCKETS + sum(n))), np.array(b, np.uint16), np.log(2 * np.array(n, np.float64) + 1).astype(np.float32)) for b, n in found]
    return [*model, (-math.log(BUCKETS), np.empty(0, np.uint16), np.empty(0, np.float32))]


def likelihoods(texts: list[str], model: list[tuple[float, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(weighted log-likelihood by text and language, trigrams by text)."""
    total, n = np.zeros((len(texts), len(model))), np.zeros(len(texts), dtype=np.int64)
    table = np.zeros(BUCKETS)
    for bucket, owner in trigrams(texts):
        own = np.bincount(owner, minlength=len(texts))
        n += own
        for k, (base, at, more) in enumerate(model):
            table[at] = more
            total[:, k] += np.bincount(owner, weights=table[bucket], minlength=len(texts)) + base * own
            table[at] = 0
    return total * (np.minimum(n, WEIGHT) / np.maximum(n, 1))[:, None], n


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def address_parts(address: Column) -> tuple[Column, Column]:
    """(host, suffix) of a URL, or of a plain host or source name; a name without a dot has no suffix."""
    plain = F.lower(F.coalesce(address.cast("string"), F.lit("")))
    host = F.regexp_extract(plain, r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return host, F.regexp_extract(host, r"\.([^.]+)$", 1)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", address_col: str | None = "source", out: tuple[str, str, str] = ("language", "confidence", "accepted"), sample: int = SAMPLE) -> DataFrame:
    """``docs`` with three more columns ``out``: the language, its posterior, and whether the row is accepted."""
    text, declared, host, suffix, key, priors = fresh([*docs.columns, *out], "__text", "__declared", "__host", "__suffix", "__key", "__priors")
    kept = [c for c in docs.columns if c.lower() not in {x.lower() for x in out}]
    address = address_parts(F.col(address_col) if address_col else F.lit(None))
    rows = docs.withColumns({text: F.coalesce(F.col(text_col).cast("string"), F.lit("")), declared: F.lower(F.col(declared_col).cast("string")) if declared_col else F.lit(None).cast("string"), host: address[0], suffix: address[1]})
    found = rows.filter(F.col(declared).isNotNull()).groupBy(declared).agg(F.count("*").alias("n")).orderBy(declared).collect()
    languages = [r[declared] for r in found]
    if not languages:
        return docs.select(*[F.col(f"`{c}`") for c in kept]).withColumns({out[0]: F.lit(None).cast("string"), out[1]: F.lit(None).cast("double"), out[2]: F.lit(False)})
    model = fit(rows.select(F.xxhash64(F.col(id_col), F.col(text)).alias("key"), F.col(text).alias("text"), F.col(declared).alias("declared")), {r[declared]: r["n"] for r in found}, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    size = len(model)
    labels = [*languages, OTHER]
    place = {x: i for i, x in enumerate(languages)}

    def parts(batches, name):
        step = max(1, CELLS // size)
        for part in slices(batches, name):
            for a in range(0, part.num_rows, step):
                yield part.slice(a, step)

    def evidence(part, name) -> tuple[np.ndarray, np.ndarray]:
        """(log evidence of the text in column ``name`` and of the declared language, trigrams)."""
        column = lambda c: part.column(part.schema.get_field_index(c)).to_pylist()
        log, n = likelihoods([t or "" for t in column(name)], shared.value)
        for i, d in enumerate(column(declared)):
            if d in place:
                log[i] += math.log(WRONG / (size - 1))
                log[i, place[d]] += math.log(1 - WRONG) - math.log(WRONG / (size - 1))
        return log, n

    def soft(batches):
        """A task's soft counts by host."""
        sums: dict[tuple[str, str], np.ndarray] = {}

        def rows_of(some):
            h, p = [*zip(*some, strict=True)], np.round(np.stack([*some.values()]), 6)
            i, j = np.nonzero(p)
            return pa.RecordBatch.from_arrays([pa.array([h[0][x] for x in i]), pa.array([h[1][x] for x in i]), pa.array(j, pa.int32()), pa.array(p[i, j])], names=["host", "suffix", "i", "p"])

        for part in parts(batches, text):
            p = _softmax(evidence(part, text)[0])
            for i, at in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                sums[at] = sums[at] + p[i] if at in sums else p[i]
                if len(sums) * size > 4 * CELLS:
                    yield rows_of(sums)
                    sums.clear()
        if sums:
            yield rows_of(sums)

    # Sums are of decimals, so that they don't depend on the order of rows.
    each = F.sum(F.col("p").cast("decimal(24,6)")).cast("double").alias("p")
    counts = written(mapped(rows.select(host, suffix, text, declared), soft, "host string, suffix string, i int, p double").groupBy("host", "suffix", "i").agg(each), "hosts")
    few = (counts.agg(F.sum(96 + F.octet_length("host") + F.octet_length("suffix"))).first()[0] or 0) <= BROADCAST
    total = np.zeros(size)
    for r in counts.groupBy("i").agg(each).collect():
        total[r["i"]] = r["p"]
    whole = ((total + 1) / (total + 1).sum()).tolist()
    vector = lambda c: F.map_from_entries(F.collect_list(F.struct("i", "p"))).alias(c)
    by_suffix = counts.groupBy("suffix", "i").agg(each).groupBy("suffix").agg(vector("s"))
    named = counts.groupBy("host", "suffix").agg(vector("p")).join(by_suffix, "suffix").select(F.col("host").alias(host), F.struct("p", "s").alias(priors))
    joined = rows.join(F.broadcast(named) if few else named, host, "left")
    own = own_text(docs, text_col)
    judged = own if own in kept else text
    ordered = joined.select(*[F.col(f"`{c}`") for c in kept], *([text] if judged == text else []), declared, priors)
    schema = type(docs.schema)([docs.schema[c] for c in kept]).add(out[0], "string").add(out[1], "double").add(out[2], "boolean")

    def judge(batches):
        for part in parts(batches, judged):
            log, n = evidence(part, judged)
            own = _softmax(log)
            # No priors where the row's host wasn't there at the count, which can't be but for a lost table.
            prior = part.column(part.schema.get_field_index(priors)).to_pylist()
            h, s = np.zeros((2, len(prior), size))
            for i, x in enumerate(prior):
                for to, c in ((h, "p"), (s, "s")):
                    for j, v in x[c] if x else ():
                        to[i, j] = v
            h, s = np.maximum(h - own, 0), np.maximum(s - own, 0)
            s = (s + SMOOTH * np.array(whole)) / (s.sum(axis=1, keepdims=True) + SMOOTH)
            h = (h + SMOOTH * s) / (h.sum(axis=1, keepdims=True) + SMOOTH)
            p = _softmax(log + np.log(np.maximum(h, 1e-12)))
            # At chance, some language's likelihood ratio reaches size / CHANCE with probability CHANCE at most.
            unlike = (log[:, :-1].max(axis=1) - log[:, -1] < math.log(size / CHANCE)) & (n > 0)
            best = np.where(unlike, size - 1, p.argmax(axis=1))
            sure = p[np.arange(len(p)), best]
            yield appended(part.select(kept), **{out[0]: pa.array([labels[i] for i in best]), out[1]: pa.array(np.round(sure, 6)), out[2]: pa.array((sure >= ACCEPT) & (n > 0) & (best < size - 1))})

    return mapped(ordered, judge, schema)

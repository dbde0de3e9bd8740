"""Vector search, and re-ranking by the dependency graph."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shared_dir, written

#: Hits of a search, of a merged result, and what a structural hit adds (fixed values).
HITS, MERGED, BOOST = 10, 5, 0.5
#: Queries that are broadcast at once; how far a score by matrix products may be below a task's n-th, well over half a unit of the 6th place.
BLOCK, MARGIN = 1024, 1e-5


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)


def _scores(x, y):
    """Inner products of the rows of two matrices over the roots of their squared lengths, and where these are no numbers."""
    import numpy as np

    with np.errstate(all="ignore"):
        lengths = np.sqrt(np.outer(np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)))
        found = (x @ y.T) / lengths
    return found, ~np.isfinite(found)


def _near(stored: DataFrame, own: list, n: int) -> DataFrame:
    """(id, embedding, at): rows of ``stored`` (id, embedding) that may be among the ``n`` nearest to the vector at place ``at`` of ``own``.

    Each task multiplies matrices and keeps what is no further than its n-th by more than :data:`MARGIN`, so no pair is lost
    to rounding; pairs without a number, and vectors that don't fit a matrix, are all kept.
    """
    import numpy as np

    size = len(own[0]) if own[0] is not None else 0
    plain = lambda v: v is not None and len(v) == size and None not in v
    fit = np.array([i for i, v in enumerate(own) if size and plain(v)], dtype="int64")
    other = np.setdiff1d(np.arange(len(own)), fit)
    matrix = np.array([own[i] for i in fit], dtype="float64").reshape(len(fit), size)
    kept = stored.sparkSession.sparkContext.broadcast((matrix, fit, other))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        matrix, fit, other = kept.value
        least = np.full(len(fit), -np.inf)  # the n-th best score of each query up to now, by this task
        best = np.full((len(fit), n), -np.inf)
        for batch in itertools.chain.from_iterable((b.slice(k, 1024) for k in range(0, b.num_rows, 1024)) for b in batches):
            vectors = batch.column(1)
            lengths = np.array([-1 if v is None else v for v in pc.list_value_length(vectors).to_pylist()])
            whole = np.flatnonzero(lengths == size) if size else np.zeros(0, "int64")
            flat = vectors.take(pa.array(whole)).flatten()
            if flat.null_count:
                whole = np.array([i for i in whole if None not in vectors[int(i)].as_py()], dtype="int64")
                flat = vectors.take(pa.array(whole)).flatten()
            odd = np.setdiff1d(np.arange(batch.num_rows), whole)
            rows, at = [np.repeat(odd, len(fit) + len(other)), np.repeat(whole, len(other))], [np.tile(np.concatenate([fit, other]), len(odd)), np.tile(other, len(whole))]
            if len(whole) and len(fit):
                scores, none = _scores(flat.to_numpy(zero_copy_only=False).astype("float64").reshape(len(whole), size), matrix)
                low = np.where(none, -np.inf, scores)
                few = low if len(whole) <= n else np.partition(low, len(whole) - n, axis=0)[len(whole) - n :]
                best = np.partition(np.concatenate([best, few.T], axis=1), len(few), axis=1)[:, len(few) :]
                least = best.min(axis=1)
                r, q = np.nonzero(none | (scores >= least - MARGIN))
                rows.append(whole[r])
                at.append(fit[q])
            rows, at = np.concatenate(rows), np.concatenate(at)
            for k in range(0, len(rows), 10_000):
                some = batch.take(pa.array(rows[k : k + 10_000]))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(at[k : k + 10_000], pa.int32())], names=["id", "embedding", "at"])

    kinds = dict(stored.dtypes)
    return stored.mapInArrow(run, f"id {kinds['id']}, embedding {kinds['embedding']}, at int")


def search(chunks: DataFrame, queries: DataFrame, n: int = HITS, block: int = BLOCK) -> DataFrame:
    """(query_id, id, distance, rank): the ``n`` nearest chunks (id, embedding) to each query (query_id, vector).

    Queries pass the driver in blocks of ``block``, which are broadcast; beyond one block, each block's hits are written before
    the next is read. Matrix products choose candidates in every task; their distances are then made in full, rounded to 6
    places, ties go to the smaller id. Every chunk is compared with every query, so work grows with both.
    """
    spark = chunks.sparkSession
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    asked = queries.select("query_id", "vector", dot(F.col("vector"), F.col("vector")).alias("vv"))
    stored = chunks.select("id", "embedding")

    def hits(some: list) -> DataFrame:
        if not some:
            near = stored.limit(0).withColumn("at", F.lit(0))
        else:
            near = _near(stored, [r["vector"] for r in some], n)
        own = F.broadcast(spark.createDataFrame([(i, *r) for i, r in enumerate(some)], f"at int, query_id {dict(asked.dtypes)['query_id']}, vector {dict(asked.dtypes)['vector']}, vv double"))
        ee = dot(F.col("embedding"), F.col("embedding"))
        scored = near.join(own, "at").select("query_id", "id", F.round(1 - dot(F.col("embedding"), F.col("vector")) / F.sqrt(ee * F.col("vv")), 6).alias("distance"))
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)

    rows = asked.toLocalIterator()
    held = list(itertools.islice(rows, block))
    following = list(itertools.islice(rows, block))
    if not following:
        return hits(held)
    path = f"{shared_dir(spark)}/hits-{uuid.uuid4().hex}"
    while held:
        hits(held).write.mode("append").parquet(path)
        held, following = following, list(itertools.islice(rows, block))
    return spark.read.parquet(path)


def merged(hits: DataFrame, structural: DataFrame, n: int = MERGED) -> DataFrame:
    """(query_id, id, score, rank): 1 - distance, and more for hits among ``structural`` (query_id, id)."""
    near = structural.select("query_id", "id", F.lit(BOOST).alias("boost")).distinct()
    scored = hits.join(near, ["query_id", "id"], "left").select("query_id", "id", F.round(1 - F.col("distance") + F.coalesce("boost", F.lit(0.0)), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def embedding_text(parsed: DataFrame) -> DataFrame:
    """(file, text): what of a parsed file is embedded."""
    item = lambda kind: lambda x: F.format_string(f"{kind} %s at line %d", x["name"], x["line"])
    lines = F.concat(F.array(F.concat(F.lit("File: "), "file")), F.transform("classes", item("Class")), F.transform("functions", item("Function")), F.when(F.size("imports") > 0, F.array(F.concat(F.lit("Imports: "), F.array_join("imports", ", ")))).otherwise(F.array().cast("array<string>")))
    return parsed.select("file", F.array_join(lines, "\n").alias("text"))


#: Places of a vector; words that are broadcast at most, the most frequent ones, and bytes of each.
SIZE, FREQUENT, BYTES = 64, 1 << 16, 64


def counted(texts: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, word, tf) of each text (.., text), written; rows with the same id count as one text.

    Words are counted where the text is. Only if ids repeat, which is checked, are counts shuffled.
    """
    own = texts.select(F.col(id_col).alias("id"), F.split(F.lower("text"), r"[^\p{L}\p{N}_]+").alias("words"))

    def count(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for part in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):
            lengths = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy(zero_copy_only=False)
            coded = part.column(1).flatten().dictionary_encode()
            size = len(coded.dictionary)
            pairs, tf = np.unique(np.repeat(np.arange(part.num_rows), lengths) * size + coded.indices.to_numpy(), return_counts=True)
            whole = pairs % max(1, size) != pc.index(coded.dictionary, "").as_py()
            pairs, tf = pairs[whole], tf[whole]
            for k in range(0, len(pairs), 100_000):
                row, word = np.divmod(pairs[k : k + 100_000], size)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), coded.dictionary.take(pa.array(word)), pa.array(tf[k : k + 100_000], pa.int64())], names=["id", "word", "tf"])

    found = own.mapInArrow(count, f"id {dict(own.dtypes)['id']}, word string, tf long")
    if not own.groupBy("id").count().filter("count > 1").isEmpty():
        found = found.groupBy("id", "word").agg(F.sum("tf").alias("tf"))
    return written(found, "words")


def dictionary(texts: DataFrame, id_col: str = "id", words: DataFrame | None = None) -> DataFrame:
    """(word, weight): ln((1 + N) / (1 + df)) + 1 of each word that df of N texts hold, and as the empty word the weight of one that none does.

    ``words`` are the texts' :func:`counted` words, if there already.
    """
    n = texts.agg(F.count("*").alias("n"))
    df = (counted(texts, id_col) if words is None else words).groupBy("word").agg(F.count("*").alias("df"))
    weight = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    unseen = n.select(F.lit("").alias("word"), F.lit(0).cast("long").alias("df"))
    return df.unionByName(unseen).crossJoin(F.broadcast(n)).select("word", weight.alias("weight"))


def hashed(texts: DataFrame, terms: DataFrame, id_col: str = "id", size: int = SIZE, words: DataFrame | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(id, place, value): places of unit vectors that aren't zero. A word adds (1 + ln tf) times its weight, or takes it away, at a place by its hash.

    The ``frequent`` words of least weight are broadcast, so most words of a text are summed up where they are; the others
    are joined by a shuffle. ``words`` are the texts' :func:`counted` words, if there already.
    """
    words = counted(texts, id_col) if words is None else words
    mark = F.md5(F.col("word").cast("binary"))
    place = F.pmod(F.conv(F.substring(mark, 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")
    sign = F.when(F.substring(mark, 9, 1) < "8", 1.0).otherwise(-1.0)
    own = written(terms.select("word", "weight", place.alias("at"), sign.alias("sign")), "terms")
    known, unseen = own.filter("word <> ''"), F.broadcast(own.filter("word = ''").select(F.col("weight").alias("other")))
    many = F.broadcast(written(known.filter(F.octet_length("word") <= BYTES).orderBy("weight", "word").limit(frequent), "terms"))
    near = words.join(many, "word").select("id", F.col("at").alias("place"), (F.col("sign") * (1 + F.log("tf")) * F.col("weight")).alias("value"))
    rest = words.join(many.select("word"), "word", "left_anti").join(known, "word", "left").crossJoin(unseen)
    rest = rest.select("id", F.coalesce("at", place).alias("place"), (F.coalesce("sign", sign) * (1 + F.log("tf")) * F.coalesce("weight", "other")).alias("value"))
    summed = near.unionByName(rest).filter("id IS NOT NULL").groupBy("id", "place").agg(F.sum("value").alias("value"))
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("id")))
    return summed.withColumn("norm", norm).filter("abs(value) > 1e-9").select("id", "place", (F.col("value") / F.col("norm")).alias("value"))


def embed(texts: DataFrame, terms: DataFrame, id_col: str = "id", size: int = SIZE) -> DataFrame:
    """``texts`` (.., text; one row for each id) with a unit vector of weighted, hashed words as ``embedding``; zeros for a text without words."""
    vectors = hashed(texts, terms, id_col, size).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float"))
    return texts.join(vectors.withColumnRenamed("id", id_col), id_col, "left").withColumn("embedding", values).drop("m")

"""A training corpus from raw documents: five stages, each over all that its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written as
Parquet and read again as the next one's documents. All but the last return the
columns of ``documents``, whatever their names, and rows as they are.

Defined cases, of every stage: an empty table gives an empty one, and a document
of any length is judged by the whole of its text. Each stage says what it does
with null and empty texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontam, language, quality, simhash
from lodestone.llm.common import fresh, made, remove_made, written
from lodestone.llm.queries import bpe_digests, table

#: No stage but the last could be said in SQL; tests hold stages against brute force or held-out labels.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, by two co-trained views of the labelled ones.

    Null texts are judged as empty ones; null sources and languages are values of their own. Repeated rows stay or go
    together. A quality of just KEEP stays. Without labels of both kinds all stay.
    """
    out = fresh(docs.columns, "__a", "__b", "__quality", "__kept")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, out=tuple(out)).filter(out[3]).select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: with letters, and a posterior of a half at least.

    Null and empty texts, and those without letters, go. Null declared languages and sources are no evidence; if no row has
    a declared language, all go. Repeated rows stay or go together, but for what they add to their source's prior.
    """
    out = fresh(docs.columns, "__language", "__confidence", "__accepted")
    return language.identify(docs, out=tuple(out)).filter(out[2]).select(docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity 0.8).

    The least id stays, null ids first, then the least hash of the text; of rows that repeat both, the least other columns.
    Null, empty and white texts are copies of each other; texts of fewer words are copies if they have the same words.
    """
    return simhash.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    Null and empty texts leak nothing, and items without words are never leaked. Repeated rows stay or go together.
    """
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the documents' ids and of the bytes that these decode to. Null texts are empty; every row gives one, repeated ones too."""
    return bpe_digests(docs.select("doc_id", "text"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents`` on."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        began = made()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
            # What the stage wrote on its way isn't needed any more, nor is what it read.
            remove_made(spark, began - (k > 0), keep=1)
    return docs

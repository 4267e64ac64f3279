"""Stages that turn raw documents into token ids: each takes (spark, docs, sf_dir) and gives the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard_join, line_dedup, mixing, toxicity
from tidemark.llm.common import read, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxicity score of at least 0.5. Weights are learned from the labelled documents outside the held-out part.

    Null and empty texts have no evidence and stay. Equal texts have equal scores, so copies and repeated rows stay or go together; ids
    only say which label a row has. Texts are scored whole. An empty table, of documents or labels, gives no rejections.
    """
    docs = docs.select(COLUMNS)
    model = toxicity.Model(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("score < 0.5").select(COLUMNS)


def strip_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strips lines that stand on many sources but for their first place. A document that loses all its words so goes; one that had none stays.

    Null texts and documents without an id stay as they are, and a null source counts for no line. Rows that are equal in id and text are
    stripped alike. n_chars is counted anew, null for a null text. Texts are cut whole. An empty table gives no rows.
    """
    got = line_dedup.strip(docs.select(COLUMNS))
    emptied = (F.col("n_removed") > 0) & (mixing.n_words(F.col("text")) == 0)
    return got.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies, that with the least id: five words to a shingle, similarity 0.8.

    Documents without words, null texts among them, stay. Rows with equal or null ids are documents by themselves, so copies of them
    go and other texts stay. Texts are compared whole. An empty table gives no rows.
    """
    return jaccard_join.one_of_each(docs.select(COLUMNS), k=5, similarity=80).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents so often that sources meet their target weights; a document stands in the result as many times.

    Texts without words, null ones among them, stay once and count for nothing. A null source is a source. Rows that are equal in all
    columns are taken as often as fits, others each by itself, with whatever ids. An empty table gives no rows.
    """
    return mixing.mixed(docs.select(COLUMNS)).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens of each document and digests of their ids and of the decoded text, in which a null text is an empty one.

    Each row gives a row, repeated ones equal rows; texts are encoded whole. An empty table gives no rows.
    """
    return bpe.encode(docs.select(COLUMNS), ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", strip_boilerplate),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: Learned scores, hashes of whole rows and merges have no SQL; tests hold the stages against plain versions on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

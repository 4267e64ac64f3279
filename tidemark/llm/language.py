"""Language identification by rank-order profiles: the out-of-place distance between a text's and a language's most frequent n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import held_out, modest, parts, read, settle, small

#: n-grams that a profile ranks, and documents of each language (expected number) that profiles are learned from.
TOP, SAMPLE = 300, 1500
_BITS = 21
_lower_letters: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point whether it is part of a word: letters and their marks."""
    global _lower_letters
    if _lower_letters is None:
        _lower_letters = np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)), bool, 0x110000)
    return _lower_letters


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a text's n-grams of 1 to 3 characters, with word ends as a character, most frequent first, and their counts.

    A key has 21 bits for each code point, the last in the lowest; ties go by key. No letters: no keys.
    """
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letters()[at]
    if not is_letter.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c = np.where(is_letter, at, 32).astype(np.uint64)
    c = np.concatenate(([np.uint64(32)], c, [np.uint64(32)]))
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    two = (c[:-1] << np.uint64(_BITS)) | c[1:]
    three = (two[:-1] << np.uint64(_BITS)) | c[2:]
    keys, counts = np.unique(np.concatenate((c[c != 32], two, three[c[1:-1] != 32])), return_counts=True)
    order = np.lexsort((keys, -counts))
    return keys[order], counts[order]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, at, np.concatenate(counts))
    return found, sums


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, "text"):
        by_lang: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(grams(text))
        for lang, own in by_lang.items():
            keys, sums = _summed(*(list(x) for x in zip(*own, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(sums)], names=["lang", "gram", "n"])


def learn(train: DataFrame, top: int = TOP, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """train (doc_id, text, lang) -> for each language the keys of its profile, by rank.

    Learns from about `sample` documents of each language, chosen by a hash of the id; all n-grams of their whole texts count.
    Of equally frequent n-grams the one with the lesser key comes first. Rows without a language or a text are passed over, rows that
    repeat count as often as they occur, and an empty table gives no profiles.
    """
    train = modest(train).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = train.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("_share"))
    some = train.join(small(settle(share)), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("_share") * 1_000_003)
    counts = some.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))).where(F.col("r") <= top)
    found: dict[str, list[tuple[int, int]]] = {}
    for row in best.collect():  # languages times `top` rows
        found.setdefault(row["lang"], []).append((row["r"], row["gram"]))
    return {lang: np.array([g for _, g in sorted(rows)], np.uint64) for lang, rows in sorted(found.items())}


class Profiles:
    def __init__(self, by_lang: dict[str, np.ndarray], top: int = TOP):
        self.langs, self.top = list(by_lang), top
        self.keys = np.unique(np.concatenate([*by_lang.values(), np.empty(0, np.uint64)]))
        self.rank = np.full((len(self.langs), len(self.keys)), -1, np.int64)
        for i, own in enumerate(by_lang.values()):
            self.rank[i, np.searchsorted(self.keys, own)] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the least out-of-place distance (ties: the first by name) and how clear that is, 0 to 1: 1 less its distance as a part of the greatest possible one."""
        own = grams(text)[0][: self.top]
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        rank = np.where(self.keys[at] == own, self.rank[:, at], -1)
        away = np.where(rank >= 0, np.minimum(np.abs(rank - np.arange(len(own))), self.top), self.top).sum(axis=1)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (self.top * len(own)))


def identify(documents: DataFrame, profiles: dict[str, np.ndarray], top: int = TOP) -> DataFrame:
    """documents (doc_id, text) -> doc_id, lang_pred, score.

    Null and empty texts and texts without letters get und and 0, and so does any text if there are no profiles. Of languages at
    equal distances the first by name is given. Texts of any length are counted whole. Rows stay as they are repeated; other
    columns are ignored.
    """
    known = modest(documents).sparkSession.sparkContext.broadcast({k: v.tolist() for k, v in profiles.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Profiles({k: np.array(v, np.uint64) for k, v in known.value.items()}, top)
        for batch in parts(batches, "text"):
            got = [own.predict(x) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = identify(docs, learn(docs.where(~held_out(F.col("doc_id")))))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

"""Cross-site boilerplate lines: the number of sites that a line stands on, by HyperLogLog sketches, exact near the threshold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, read, settle, small, written

#: Sites that make a line boilerplate; a line of fewer than WORDS words needs SHORT times as many, as ordinary words stand alone too; log2 of a
#: sketch's registers; places of lines to be dropped that may be broadcast in all.
SITES, WORDS, SHORT, LG, PLACES = 10, 5, 2, 12, 4_000_000


def _lines(documents: DataFrame, sites: int, min_words: int) -> DataFrame:
    """_id, _hash (of the text), _pos, _site, two hashes of each line with a word, and the sites that it needs: written once, for all steps. Lines are compared without white space at their ends."""
    docs = documents.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("source").cast("string").alias("_site"))
    each = docs.select("_id", F.xxhash64("_text").alias("_hash"), "_site", F.posexplode(F.split("_text", "\n")).alias("_pos", "_raw"))
    each = each.withColumn("_key", F.btrim("_raw", F.lit(" \t\r\x0b\x0c"))).withColumn("_words", F.regexp_count("_key", F.lit(WORD))).where("_words > 0")
    need = F.when(F.col("_words") >= min_words, sites).otherwise(SHORT * sites).alias("_need")
    return written(each.select("_id", "_hash", "_pos", "_site", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("second"), "_key").alias("_h2"), need), "lines")


def _spread(lines: DataFrame, lg: int) -> DataFrame:
    """_h1, _h2 of each line that stands on at least as many sites as it needs, and _first, the id and place where it stands first.

    A sketch for each line merges over all tasks. Where the estimate is within three standard errors (one site at
    least) of the threshold, the sites are counted exactly. A null source adds no site.
    """
    spread = lines.groupBy("_h1", "_h2").agg(
        F.hll_sketch_agg("_site", F.lit(lg)).alias("_sketch"), F.min(F.struct("_id", "_pos")).alias("_first"), F.count("*").alias("_n"), F.max("_need").alias("_need")
    )
    slack = F.greatest(F.lit(1.0), F.col("_need") * (3 * 1.04 / math.sqrt(1 << lg)))
    spread = spread.where("_n >= _need").withColumns({"_about": F.hll_sketch_estimate("_sketch"), "_slack": slack}).where("_about >= _need - _slack")
    spread = settle(spread.select("_h1", "_h2", "_first", "_need", F.expr("_about > _need + _slack").alias("_sure")))
    near = spread.where(~F.col("_sure")).select("_h1", "_h2", "_first", "_need")
    counted = lines.select("_h1", "_h2", "_site").join(small(near), ["_h1", "_h2"]).groupBy("_h1", "_h2")
    counted = counted.agg(F.countDistinct("_site").alias("_sites"), F.first("_first").alias("_first"), F.first("_need").alias("_need"))
    return spread.where("_sure").select("_h1", "_h2", "_first").unionByName(counted.where("_sites >= _need").select("_h1", "_h2", "_first"))


def boilerplate(documents: DataFrame, sites: int = SITES, min_words: int = WORDS, lg: int = LG) -> DataFrame:
    """documents (doc_id, text, source) -> _h1, _h2, _first of each line that stands on at least `sites` sources, one of fewer than `min_words` words on SHORT times as many."""
    return _spread(_lines(documents, sites, min_words), lg)


def strip(documents: DataFrame, sites: int = SITES, min_words: int = WORDS, lg: int = LG) -> DataFrame:
    """documents (doc_id, text, source, ...) with text stripped of boilerplate lines and n_lines, n_removed added.

    The first place of a boilerplate line, by doc_id (null first) and then position, keeps it, so that no content is lost. Lines without words always
    stay, and so do all in a document without an id. A null text has 0 lines and stays null; an empty one has 1. Equal rows are treated alike. Texts are
    cut whole; an empty table gives no rows. Columns n_lines and n_removed of the input are replaced, the others kept.
    """
    lines = _lines(documents, sites, min_words)
    found = settle(_spread(lines, lg))
    others = [c for c in documents.columns if c not in ("doc_id", "text", "n_lines", "n_removed")]
    docs = documents.select("doc_id", "text", F.struct(F.lit(1).alias("_one"), *[F.col(f"`{c}`") for c in others]).alias("_rest"), F.xxhash64("text").alias("_hash"))
    hits = lines.where(F.col("_id").isNotNull()).select("_id", "_hash", "_pos", "_h1", "_h2").join(small(found), ["_h1", "_h2"])
    hits = hits.where(F.struct("_id", "_pos") != F.col("_first")).groupBy("_id", "_hash").agg(F.collect_set("_pos").alias("_drop"))
    hits = settle(hits.withColumnRenamed("_hash", "_hash2"))
    places = hits.agg(F.sum(F.array_size("_drop"))).first()[0] or 0
    got = docs.join(F.broadcast(hits) if places <= PLACES else hits, (F.col("doc_id") == F.col("_id")) & (F.col("_hash") == F.col("_hash2")), "left")
    pieces = F.split("text", "\n")
    kept: Column = F.array_join(F.filter(pieces, lambda _, i: ~F.array_contains("_drop", i)), "\n")
    return got.select(
        "doc_id", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(kept).alias("text"), *[F.col("_rest").getField(c).alias(c) for c in others],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(pieces)).cast("long").alias("n_lines"), F.coalesce(F.array_size("_drop"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = strip(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return got.select("doc_id", "n_lines", "n_removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
e AS (SELECT doc_id, source, unnest(lines) AS raw, unnest(range(len(lines))) AS pos FROM d),
l AS (SELECT doc_id, source, pos, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM e),
c AS (SELECT *, len(regexp_extract_all(k, '[^\x20\x09-\x0D]+')) AS words FROM l WHERE words > 0),
b AS (SELECT k, min({'d': doc_id, 'p': pos}) AS f FROM c GROUP BY k, words HAVING count(DISTINCT source) >= CASE WHEN words >= 5 THEN 10 ELSE 20 END),
h AS (SELECT c.doc_id, list(c.pos) AS gone FROM c JOIN b USING (k) WHERE NOT (c.doc_id = b.f.d AND c.pos = b.f.p) GROUP BY c.doc_id),
j AS (
  SELECT d.doc_id, len(d.lines)::BIGINT AS n_lines, coalesce(len(h.gone), 0)::BIGINT AS n_removed,
    array_to_string([x for x, i in d.lines if h.gone IS NULL OR NOT list_contains(h.gone, i - 1)], chr(10)) AS kept
  FROM d LEFT JOIN h USING (doc_id))
SELECT doc_id, n_lines, n_removed, length(coalesce(kept, ''))::BIGINT AS kept_chars, md5(coalesce(kept, '')) AS kept_md5 FROM j
"""

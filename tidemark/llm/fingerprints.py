"""Document fingerprints by one-permutation MinHash, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, read, settle, small

#: log2 of the bins, words of a shingle, and low-order bits that a bin stores.
LG_BINS, SHINGLE, BITS = 7, 5, 8
#: Documents that stand in one stretch of the order by identifier, about.
STRETCH = 2_000


def with_signature(df: DataFrame, text: str, out: str, lg_bins: int = LG_BINS, words: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """df with `out`, array<smallint> of the low bits of each bin's least shingle hash; null for a text without words.

    Words are lower-cased in A-Z and cut at ASCII white space; fewer words than a shingle has make one shingle. Each shingle is
    hashed once: the highest bits name its bin, and after a sort the first hash of a bin is its least. An empty bin takes the value
    of the full bin that a hash of both bins' numbers puts first, which is the same choice for any two texts with the same full bins.
    """
    shift = 64 - lg_bins
    low = ascii_lower(F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")))
    df = df.withColumn("_h", F.when(F.coalesce(F.length(low), F.lit(0)) > 0, F.transform(F.split(low, SPACE), lambda w: F.xxhash64(w))))
    runs = ", ".join(f"_h[i + {k}]" for k in range(words))
    df = df.withColumn("_s", F.sort_array(F.expr(f"CASE WHEN size(_h) < {words} THEN array(xxhash64(_h)) ELSE transform(sequence(0, size(_h) - {words}), i -> xxhash64({runs})) END")))
    df = df.drop("_h").withColumn("_m", F.expr(f"filter(_s, (x, i) -> i = 0 OR shiftright(x, {shift}) != shiftright(_s[i - 1], {shift}))"))
    df = df.drop("_s").withColumn("_b", F.transform("_m", lambda x: F.shiftright(x, shift)))
    lowest, highest, mask = -(1 << lg_bins - 1), (1 << lg_bins - 1) - 1, (1 << bits) - 1
    own = f"CAST(_m[CAST(array_position(_b, i) AS INT) - 1] & {mask} AS SMALLINT)"
    lent = f"CAST(array_min(transform(_m, x -> named_struct('r', xxhash64(i, shiftright(x, {shift})), 'x', x))).x & {mask} AS SMALLINT)"
    full = f"transform(_m, x -> CAST(x & {mask} AS SMALLINT))"
    sparse = f"transform(sequence({lowest}L, {highest}L), i -> CASE WHEN array_contains(_b, i) THEN {own} ELSE {lent} END)"
    return df.withColumn(out, F.expr(f"CASE WHEN _m IS NULL THEN NULL WHEN size(_m) = {1 << lg_bins} THEN {full} ELSE {sparse} END")).drop("_m", "_b")


def packed(signature: Column, bits: int = BITS) -> Column:
    """A signature as a string: two hexadecimal digits a bin; the empty string for a text without words."""
    digits = -(-bits // 4)
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), digits, "0")), ""), F.lit(""))


def likeness(a: str, b: str, lg_bins: int = LG_BINS, bits: int = BITS) -> Column:
    """The estimated Jaccard similarity of two signatures: the share of equal bins, less what chance makes equal. Two texts without words: 1; one: 0."""
    chance = 2.0**-bits
    same = F.expr(f"size(filter(sequence(0, {(1 << lg_bins) - 1}), i -> {a}[i] = {b}[i]))") / float(1 << lg_bins)
    return F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def _tree(key: Column, bounds: list[int], first: int = 0) -> Column:
    """The number of bounds up to key, by a binary search of conditions."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(key < bounds[mid], _tree(key, bounds[:mid], first)).otherwise(_tree(key, bounds[mid + 1 :], first + mid + 1))


def in_stretches(docs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """docs with _k (the identifier; null as the least) and _bucket, which ascends with _k.

    Up to 256 ranges by approximate quantiles, each cut into equally wide ones, so that a bucket has about `stretch` documents.
    Expressions have those bounds as literals.
    """
    least = -(1 << 63)
    slim = docs.select("doc_id")
    n = slim.count()
    pieces = max(1, -(-n // stretch))
    top = min(256, pieces)
    cuts = sorted({int(x) for x in slim.approxQuantile("doc_id", [i / top for i in range(1, top)], 0.2 / top)}) if top > 1 else []
    docs = docs.withColumn("_k", F.coalesce(F.col("doc_id").cast("long"), F.lit(least)))
    bucket = _tree(F.col("_k"), cuts).cast("long")
    docs = docs.withColumn("_bucket", bucket)
    if pieces > top:
        finer = -(-pieces // top)
        ends = slim.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
        low = F.array(*[F.lit(int(x)) for x in [ends["a"], *cuts]])
        high = F.array(*[F.lit(int(x)) for x in [*cuts, ends["b"] + 1]])
        at = F.col("_bucket").cast("int") + 1
        inside = (F.col("_k").cast("double") - F.element_at(low, at)) / (F.element_at(high, at).cast("double") - F.element_at(low, at))
        docs = docs.withColumn("_bucket", F.col("_bucket") * finer + F.least(F.lit(finer - 1), F.greatest(F.lit(0), F.floor(inside * finer))))
    return docs


def _split(docs: DataFrame, stretch: int) -> DataFrame:
    """docs with _part, which ascends in a bucket with (_k, _t): 0 but for identifiers that many rows have, null ones too. Those rows are cut by ranges of their texts' hash _t."""
    docs = docs.withColumn("_t", F.xxhash64("text"))
    wide = settle(docs.groupBy("_bucket").agg(F.count("*").alias("_n")).where(F.col("_n") > 4 * stretch))
    hot = settle(docs.join(small(wide.select("_bucket")), "_bucket").groupBy("_k").agg(F.count("*").alias("_n")).where(F.col("_n") > 2 * stretch))
    if hot.isEmpty():
        return docs.withColumn("_part", F.struct(F.lit(0).alias("side"), F.lit(0).cast("long").alias("own"), F.lit(0).alias("range")))
    # before the hot identifiers of a bucket, at one of them, or between two: the order of parts is that of _k
    ways = F.ceil(F.col("_n") / stretch).cast("int")
    table = hot.select(F.col("_k").alias("_hot"), ways.alias("_ways"))
    docs = docs.join(small(table), F.col("_k") == F.col("_hot"), "left")
    keys = hot.join(docs.select("_k", "_bucket").distinct(), "_k").groupBy("_bucket").agg(F.sort_array(F.collect_set("_k")).alias("_keys"))
    docs = docs.join(small(settle(keys)), "_bucket", "left")
    own = F.when(F.col("_keys").isNull(), F.lit(None).cast("long")).otherwise(F.array_max(F.filter("_keys", lambda x: x <= F.col("_k"))))
    place = F.least(F.col("_ways") - 1, F.floor((F.col("_t").cast("double") / 2.0**64 + 0.5) * F.col("_ways")))
    part = F.struct(
        F.when(own.isNull(), 0).otherwise(1).alias("side"), F.coalesce(own, F.lit(0)).alias("own"), F.when(F.col("_ways").isNull(), 1 << 30).otherwise(place).cast("int").alias("range")
    )
    return docs.withColumn("_part", part).drop("_hot", "_ways", "_keys")


def with_next(docs: DataFrame, columns: list[str], stretch: int = STRETCH) -> DataFrame:
    """docs with next_<column> of the document that follows by doc_id (null first; equal identifiers: by a hash of the text, then the text), the first after the last.

    One shuffle deals out stretches of the order; each also gets a copy of the first document of the next stretch, as its last row.
    An identifier that many rows share, null included, is cut into stretches by that hash; only rows that share the text as well stand in one.
    """
    docs = _split(in_stretches(docs, stretch), stretch)
    order = W.orderBy("_bucket", "_part")
    # one row a stretch; the first follows the last
    firsts = docs.groupBy("_bucket", "_part").agg(F.min(F.struct("_k", "_t")).alias("_first"))
    here = F.struct("_bucket", "_part")
    prior = F.coalesce(F.lag(here).over(order), F.max(here).over(W.partitionBy()))
    firsts = settle(firsts.select(F.col("_bucket").alias("_b"), F.col("_part").alias("_p"), "_first", prior.alias("_prior")))
    same = (F.col("_bucket") == F.col("_b")) & (F.col("_part") == F.col("_p")) & (F.struct("_k", "_t") == F.col("_first"))
    both = docs.join(small(firsts), same, "left")
    ahead = F.struct(F.col("_prior").alias("at"), F.lit(True).alias("tail"))
    stay = F.struct(here.alias("at"), F.lit(False).alias("tail"))
    both = both.withColumn("_to", F.explode(F.when(F.col("_prior").isNull(), F.array(stay)).otherwise(F.array(stay, ahead))))
    both = both.withColumns({"_at": F.col("_to.at"), "_tail": F.col("_to.tail")}).drop("_to", "_first", "_prior", "_b", "_p")
    follow = W.partitionBy("_at").orderBy("_tail", "_k", "_t", "text")
    return both.withColumns({f"next_{c}": F.lead(c).over(follow) for c in columns}).where(~F.col("_tail")).drop("_at", "_tail", "_k", "_t", "_bucket", "_part")


def fingerprints(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last quarter of the code points replaced by the first of the next document; the order is that of `with_next`: null
    identifiers first, equal ones by their texts' hashes, so that results don't depend on the rows' places. A null text is an empty
    one; a text without words has the empty fingerprint. Texts of any length are read whole; rows that repeat follow each other. A table of
    one document has itself as the next, an empty one gives no rows. Other columns are ignored.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_signature(docs, "text", "sig")
    docs = with_next(docs, ["text", "sig"]).withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substr("next_text", F.lit(1), quarter)))
    docs = with_signature(docs.drop("text", "next_text"), "edited", "sig2")
    return docs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), packed(F.col("sig")).alias("fingerprint"),
        packed(F.col("sig2")).alias("edited_fingerprint"), likeness("sig", "sig2").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"),
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))

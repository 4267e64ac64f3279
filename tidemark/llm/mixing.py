"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, read, settle, small

WEIGHTS, TOTAL, EPOCHS, SEED = (3, 1, 2), 1.5, 2.0, "mix-7"
#: Hexadecimal digits of the seeded order that make a bucket: 4096 buckets a source. Sources up to which what is known of each is broadcast.
DIGITS, SOURCES = 3, 100_000


def water_fill(sources: DataFrame, weights=WEIGHTS, total: float = TOTAL, epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target).

    Targets are min(level * weight, epochs * source_size), with the level at which they add up to total * all sizes.
    That is what clamping and resharing by weight until nobody is above its cap ends in; sorting the sources by the
    level that fills them gives it in one pass. Weights repeat over the sources by code point, null last. One row for
    each source stands in one task here, never a document. A source of size 0 gets 0; if all caps together stay
    below the total, each source gets its cap.
    """
    ranked = sources.withColumn("_n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    filled = ranked.withColumn("weight", weight).withColumn("_cap", F.lit(float(epochs)) * F.col("source_size"))
    order = W.orderBy(F.col("_cap") / F.col("weight"), "_n")
    everything = W.partitionBy()
    filled = filled.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(total)) - F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).alias("_left"),
        F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).alias("_sharing"),
    ).withColumn("_level", F.col("_left") / F.col("_sharing"))
    level = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("weight")).alias("r"), "_n", "_level"))).over(everything)["_level"]
    filled = filled.withColumn("_at", level)
    return filled.select("source", "source_size", "weight", F.coalesce(F.least(F.col("_at") * F.col("weight"), F.col("_cap")), F.col("_cap")).alias("target"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(seed: str, *more: str) -> Column:
    """The place of a document in the seeded order of its source: md5 of its id, its size, and what else tells rows apart."""
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string"), *[F.col(c) for c in more]]
    return F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))


def units_of(rows: DataFrame, seed: str = SEED, more: tuple[str, ...] = ()) -> DataFrame:
    """rows (doc_id, size, source, *more) -> _key, doc_id, size, source, copies: rows that are alike in all of these are one unit, however many."""
    keyed = rows.select(_key(seed, *more).alias("_key"), "doc_id", "size", "source")
    return settle(keyed.groupBy("_key", "doc_id", "size", "source").agg(F.count("*").alias("copies")))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _pass(units: DataFrame, state: DataFrame) -> DataFrame:
    """One pass of the fractional repetition over units behind `lo` that fit into what is left (`room`): for each source of state (_source, lo, room) the
    first that doesn't fit behind those before it (`hi`, null if all fit), copies of it that do (`some`), and what is left then."""
    alive = units.join(small(state, SOURCES), _same("source", "_source")).where((F.col("_key") > F.col("lo")) & (F.col("size") <= F.col("room")) & (F.col("size") > 0))
    alive = alive.withColumns({"_bucket": F.substring("_key", 1, DIGITS), "_all": F.col("size") * F.col("copies")})
    # sizes by bucket of the order first, so that only the bucket in which a source's room ends is sorted
    sums = alive.groupBy("_source", "room", "_bucket").agg(F.sum("_all").alias("_sum"))
    upto = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    sums = sums.withColumn("_end", F.sum("_sum").over(upto))
    cuts = sums.groupBy("_source").agg(
        F.min(F.when(F.col("_end") > F.col("room"), F.struct("_bucket", (F.col("_end") - F.col("_sum")).alias("start")))).alias("_cut"), F.max("_end").alias("_total")
    )
    cuts = settle(cuts.select(F.col("_source").alias("_cut_source"), "_cut", "_total"))
    edge = alive.join(small(cuts.where("_cut IS NOT NULL"), SOURCES), _same("_source", "_cut_source") & (F.col("_bucket") == F.col("_cut._bucket")))
    before = W.partitionBy("_source").orderBy("_key").rowsBetween(W.unboundedPreceding, -1)
    edge = edge.withColumn("_before", F.col("_cut.start") + F.coalesce(F.sum("_all").over(before), F.lit(0)))
    first = edge.where(F.col("_before") + F.col("_all") > F.col("room")).groupBy("_source").agg(F.min(F.struct("_key", "_before", "size")).alias("_at"))
    first = first.select(F.col("_source").alias("_at_source"), "_at")
    got = state.join(cuts, _same("_source", "_cut_source")).join(first, _same("_source", "_at_source"), "left")
    some = F.when(F.col("_at").isNotNull(), F.floor((F.col("room") - F.col("_at._before")) / F.col("_at.size"))).otherwise(F.lit(0))
    got = got.withColumn("some", some.cast("long"))
    used = F.when(F.col("_at").isNull(), F.col("_total")).otherwise(F.col("_at._before") + F.col("some") * F.col("_at.size"))
    return settle(got.select("_source", "lo", "room", F.col("_at._key").alias("hi"), "some", (F.col("room") - used).alias("left")))


def allot(units: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How often units are taken, as two small tables.

    By source: source_size, target, _whole (the times that each copy is taken), _rest (what the target is more) and _passes; a
    unit is taken once more, with all its copies, if it is in a pass (`in_pass`). And the units (_source, _key) of which only some copies are taken once more, with their
    number `some`: at most one a pass and one at the end.

    The rest of a target goes to the documents in the seeded order, each that fits into what is left at its turn. A pass takes documents up to the first
    that doesn't fit; the next one goes on behind it with those that fit into what is left then, until none does. In a random order each pass uses a
    good part of what is left, so passes are few. At the end the document whose size is nearest to what is left is taken
    too, if that brings the source nearer to its target (ties: the first in the order).
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.select(F.col("source").alias("_source"), "source_size", "target", whole.alias("_whole"))
    plan = settle(plan.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")))
    state = plan.where("_rest > 0").select("_source", F.lit("").alias("lo"), F.col("_rest").alias("room"))
    done: list[DataFrame] = []
    while True:
        got = _pass(units, state)
        done.append(got)
        state = got.where("hi IS NOT NULL AND left >= 1").select("_source", F.col("hi").alias("lo"), F.col("left").alias("room"))
        if state.isEmpty():
            break
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    every = settle(every)
    by_source = every.groupBy("_source").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "room"))).alias("_passes"), F.min("left").alias("_left"))
    plan = settle(plan.join(by_source.withColumnRenamed("_source", "_pass_source"), _same("_source", "_pass_source"), "left").drop("_pass_source"))
    partly = every.where("some > 0").select("_source", F.col("hi").alias("_key"), "some")

    spare = units.join(small(plan.where("_rest > 0"), SOURCES), _same("source", "_source"))
    left = F.coalesce("_left", "_rest")
    spare = spare.where((F.col("size") > 0) & ~in_pass() & (F.col("size") < 2 * left))
    known = partly.select(F.col("_source").alias("_s"), F.col("_key").alias("_k"), F.col("some").alias("_some"))
    spare = spare.join(small(settle(known), SOURCES), _same("_source", "_s") & (F.col("_key") == F.col("_k")), "left").where(F.coalesce("_some", F.lit(0)) < F.col("copies"))
    last = spare.groupBy("_source").agg(F.min(F.struct(F.abs(left - F.col("size")).alias("off"), "_key")).alias("_last"))
    partly = partly.unionByName(last.select("_source", F.col("_last._key").alias("_key"), F.lit(1).cast("long").alias("some")))
    return plan.drop("_left"), settle(partly.groupBy("_source", "_key").agg(F.sum("some").alias("some")))


def in_pass() -> Column:
    """Whether a unit (_key, size) is taken once more with all its copies, by its source's _passes; one without words is wherever there are any."""
    inside = F.exists("_passes", lambda p: (F.col("_key") > p["lo"]) & (p["hi"].isNull() | (F.col("_key") < p["hi"])) & (F.col("size") <= p["room"]))
    return (F.col("_rest") > 0) & ((F.col("size") == 0) | F.coalesce(inside, F.lit(False)))


def _targets(units: DataFrame, weights, total: float, epochs: float) -> DataFrame:
    return water_fill(units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, total, epochs)


def mix(documents: DataFrame, weights=WEIGHTS, total: float = TOTAL, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """documents (doc_id, text, source) -> doc_id, size, source, source_size, target, reps, taken.

    A null or empty text has size 0; null sources are one source, the last. Rows that repeat an id and a size in a source, null ids included, are one unit of the
    seeded order, of which as many copies are taken as fit. What a source misses of its
    target is half of the shortest document at most that isn't taken once more. An empty table gives no rows. Other columns are ignored.
    """
    units = units_of(documents.select("doc_id", n_words(F.col("text")).alias("size"), "source"), seed)
    plan, partly = allot(units, _targets(units, weights, total, epochs))
    got = units.join(small(plan, SOURCES), _same("source", "_source")).drop("_source")
    partly = partly.select("_source", F.col("_key").alias("_k"), "some")
    got = got.join(small(partly, SOURCES), _same("source", "_source") & (F.col("_key") == F.col("_k")), "left")
    more = F.when(in_pass(), F.col("copies")).otherwise(F.coalesce("some", F.lit(0)))
    got = got.withColumn("_more", more).withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    got = got.withColumn("reps", (F.col("_whole") + F.when(F.col("_turn") <= F.col("_more"), 1).otherwise(0)).cast("long"))
    return got.select("doc_id", "size", "source", "source_size", "target", "reps", (F.col("size") * F.col("reps")).alias("taken"))


def mixed(documents: DataFrame, weights=WEIGHTS, total: float = TOTAL, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """The documents (doc_id, text, source, ...) themselves, each as often as `mix` takes it, those without words once; only rows that are equal in all columns are one unit here.

    How often a row is taken is found from the row and its source's passes, so texts aren't shuffled; but for the few units of
    which only some copies are taken: of those the copies, which are equal, become one row that is repeated.
    """
    every = [F.col(f"`{c}`") for c in documents.columns]
    content = F.concat_ws("-", F.hex(F.xxhash64(*every)), F.hex(F.xxhash64(F.lit("second"), *every)))
    rows = documents.select(F.struct(*every).alias("_row"), "doc_id", n_words(F.col("text")).alias("size"), "source", content.alias("_content"))
    units = units_of(rows, seed, ("_content",))
    plan, partly = allot(units, _targets(units, weights, total, epochs))
    partly = settle(partly.join(units.select("_key", "source", "copies"), "_key").where(_same("_source", "source")).select(F.col("_source").alias("_s"), F.col("_key").alias("_k"), "some", "copies"))
    rows = rows.withColumn("_key", _key(seed, "_content")).join(small(plan, SOURCES), _same("source", "_source"))
    rows = rows.join(small(partly, SOURCES), _same("source", "_s") & (F.col("_key") == F.col("_k")), "left")
    reps = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("_whole") + F.when(in_pass(), 1).otherwise(0))
    whole = rows.where("some IS NULL").withColumn("reps", reps.cast("long")).select("_row", "reps")
    some = rows.where("some IS NOT NULL").groupBy("source", "_key").agg(F.first("_row").alias("_row"), F.first(F.col("_whole") * F.col("copies") + F.col("some")).alias("reps"))
    both = whole.unionByName(some.select("_row", "reps")).where("reps > 0")
    return both.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("reps").cast("long")))).select("_row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


#: A source's documents are gone through one by one in the order of k; each is taken once more that fits into what is left.
OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS n FROM d GROUP BY source),
w AS (
  SELECT *, CASE n % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, cap / weight AS r,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
v AS (SELECT level AS full_level FROM l WHERE level * weight <= cap ORDER BY r, n LIMIT 1),
t AS (SELECT source, n, source_size, coalesce(least((SELECT full_level FROM v) * weight, cap), cap) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
o AS (
  SELECT d.doc_id, d.source, d.size, p.n, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
    row_number() OVER (PARTITION BY p.n ORDER BY md5('mix-7:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || d.size::VARCHAR)) AS place
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
g AS (
  SELECT n, 0::BIGINT AS place, target - whole * source_size AS room, false AS took FROM p
  UNION ALL
  SELECT g.n, o.place, CASE WHEN o.rest > 0 AND o.size <= g.room THEN g.room - o.size ELSE g.room END, o.rest > 0 AND o.size <= g.room
  FROM g JOIN o ON o.n = g.n AND o.place = g.place + 1),
e AS (SELECT o.*, g.took, min(g.room) OVER (PARTITION BY o.n) AS room FROM o JOIN g ON o.n = g.n AND o.place = g.place),
f AS (
  SELECT *, rest > 0 AND NOT took AND size > 0 AND size < 2 * room AS could FROM e),
h AS (SELECT *, row_number() OVER (PARTITION BY n, could ORDER BY abs(room - size), place) AS nearest FROM f)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN took OR (could AND nearest = 1) THEN 1 ELSE 0 END))::BIGINT AS taken, source
FROM h
"""

"""Futures contracts: inventory, request planning, the decision to roll, and price gaps where the contract changes."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import RESEARCH
from tidemark.functions import clock


def inventory(spark: SparkSession, product: str, first: date, last: date, fallback: int = RESEARCH.roll_fallback) -> DataFrame:
    """Quarterly contracts whose planned roll isn't before the first day, up to 120 days past the last: symbol, expiry, planned_roll, next_symbol."""
    years = spark.range(first.year, last.year + 2).withColumnRenamed("id", "y")
    months = years.select("y", F.explode(F.array(*[F.lit(m) for m in clock.MONTH_CODES])).alias("m"))
    out = months.withColumn("expiry", clock.third_friday(F.make_date("y", "m", F.lit(1)))).withColumn("planned_roll", clock.business_days_before(F.col("expiry"), fallback))
    out = out.where((F.col("planned_roll") >= F.lit(first)) & (F.col("expiry") <= F.lit(last + timedelta(days=120))))
    out = out.withColumn("symbol", clock.contract_symbol(F.lit(product), F.col("expiry")))
    return out.select("symbol", "expiry", "planned_roll", F.lead("symbol").over(W.orderBy("expiry")).alias("next_symbol"))  # a few rows a year


def roll_windows(contracts: DataFrame, lookback: int = RESEARCH.roll_lookback) -> DataFrame:
    """For each contract and the one after it, the days whose volumes decide the roll: pair, role, symbol, first_day, last_day."""
    pairs = contracts.where(F.col("next_symbol").isNotNull()).withColumn("first_day", F.date_sub("expiry", lookback))
    return pairs.select("symbol", "next_symbol", "first_day", F.col("expiry").alias("last_day"), F.expr("stack(2, 'front', symbol, 'next', next_symbol) AS (role, request_symbol)")).select(F.col("symbol").alias("pair"), "role", "request_symbol", "first_day", "last_day")


def chunks(requests: DataFrame, days: int = RESEARCH.chunk_days) -> DataFrame:
    """Requests (symbol, first_day, last_day) cut into stretches of at most so many days, with an identifier made of what is asked for."""
    start = F.explode(F.sequence("first_day", "last_day", F.expr(f"INTERVAL {days} DAYS")))
    out = requests.withColumn("chunk_start", start).withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.col("last_day")))
    return out.withColumn("request_id", F.substring(F.sha2(F.concat_ws("|", "symbol", F.col("chunk_start").cast("string"), F.col("chunk_end").cast("string")), 256), 1, 20))


def remaining(planned: DataFrame, ledger: DataFrame, key: str = "request_id", done=("success", "empty", "cached_verified")) -> DataFrame:
    """Planned work that the ledger doesn't have as done."""
    return planned.join(ledger.where(F.col("status").isin(*done)).select(key), key, "left_anti")


def decisions(volumes: DataFrame, pairs: DataFrame, confirm: int = RESEARCH.roll_confirm) -> DataFrame:
    """When each pair rolls: volumes (pair, day, front_volume, next_volume) of days that both contracts have, pairs (pair, expiry, planned_roll).

    The roll is confirmed on the day that ends a streak of `confirm` such days, before expiry, on which the next contract trades
    more; it takes effect on the weekday after. Without one, the planned roll stands.
    """
    at = W.partitionBy("pair").orderBy("day")
    both = volumes.where("front_volume IS NOT NULL AND next_volume IS NOT NULL").join(pairs.select("pair", "expiry"), "pair").where("day < expiry")
    both = both.withColumn("_more", F.col("next_volume") > F.col("front_volume"))
    both = both.withColumn("_breaks", F.sum((~F.col("_more")).cast("int")).over(at.rowsBetween(W.unboundedPreceding, 0)))
    both = both.withColumn("_streak", F.sum(F.col("_more").cast("int")).over(W.partitionBy("pair", "_breaks").orderBy("day").rowsBetween(W.unboundedPreceding, 0)))
    first = both.where(F.col("_more") & (F.col("_streak") >= confirm)).groupBy("pair").agg(F.min("day").alias("confirmed"))
    out = pairs.join(first, "pair", "left")
    return out.withColumn("roll_day", F.coalesce(clock.next_weekday(F.col("confirmed")), "planned_roll")).withColumn("method", F.when(F.col("confirmed").isNull(), "planned").otherwise("volume"))


def boundaries(bars: DataFrame, symbol: str = "symbol", by: str = "product") -> DataFrame:
    """The first change of contract in each session: the symbols, and the open's gap to the last close before."""
    at = W.partitionBy(by).orderBy("ts")
    moved = bars.withColumns({"previous_symbol": F.lag(symbol).over(at), "previous_close": F.lag("close").over(at)}).where(F.col(symbol) != F.col("previous_symbol"))
    first = moved.withColumn("_r", F.row_number().over(W.partitionBy(by, "session_date").orderBy("ts"))).where("_r = 1")
    return first.select(by, "session_date", "ts", "previous_symbol", F.col(symbol).alias("symbol"), (F.col("open") - F.col("previous_close")).alias("gap"))

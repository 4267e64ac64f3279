"""Bars and sessions out of general tables: events as ticks, orders as daily sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import SESSION, SessionSpec
from tidemark.functions import clock


def bar_open(ts, minutes: int):
    """The start of the bar of so many minutes that holds an instant."""
    return F.timestamp_add("MINUTE", -(clock.minute_of_day(ts) % minutes), F.date_trunc("minute", ts).cast("timestamp_ntz"))


def bars_from_events(events: DataFrame, minutes: int, by: str | None = None) -> DataFrame:
    """Events (event_id, ts, value) as bars of so many minutes, for each value of `by` too.

    Within a bar, an event is up if its value isn't below the one before (the first is up). Volumes are hundredths of the values.
    One shuffle by bar serves the order of ticks and the aggregate.
    """
    keys = ["ts"] if by is None else [by, "ts"]
    ticks = events.where(F.col("value").isNotNull() & F.col("ts").isNotNull()).select(*([by] if by else []), "event_id", F.col("ts").alias("_at"), bar_open(F.col("ts"), minutes).alias("ts"), "value")
    at = W.partitionBy(*keys).orderBy("_at", "event_id")
    ticks = ticks.withColumn("_up", F.coalesce(F.col("value") >= F.lag("value").over(at), F.lit(True)))
    when, volume = F.struct("_at", "event_id"), F.round(F.col("value") * 100).cast("long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return ticks.groupBy(*keys).agg(
        F.min_by("value", when).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", when).alias("close"),
        total(F.when(F.col("_up"), volume)).alias("up_volume"), total(F.when(~F.col("_up"), volume)).alias("down_volume"),
        F.count_if(F.col("_up")).alias("up_ticks"), F.count_if(~F.col("_up")).alias("down_ticks"),
        total(volume).alias("total_volume"), F.count("*").alias("total_ticks"),
    )


def labelled(bars: DataFrame, spec: SessionSpec = SESSION) -> DataFrame:
    """Bars with session_date, clock (minutes since the scheduled open), rth_minute, is_rth and in_session."""
    ts = F.col("ts")
    return bars.withColumns({
        "session_date": clock.session_date(ts, spec), "clock": clock.scheduled_minute(ts, spec), "rth_minute": clock.rth_minute(ts, spec), "is_rth": clock.is_rth(ts, spec),
    }).withColumn("in_session", (F.col("clock") < spec.minutes) & (F.weekday("session_date") < 5))


def session_bars(events: DataFrame, minutes: int, spec: SessionSpec = SESSION) -> DataFrame:
    """The labelled bars that stand inside a weekday's session."""
    return labelled(bars_from_events(events, minutes), spec).where("in_session").drop("in_session")


def sessions_from_orders(orders: DataFrame, by: str | None = None) -> DataFrame:
    """Orders as daily sessions: open, high, low, close by key, volume the number of orders. A day counts as expected on weekdays, and as usable if a weekday."""
    keys = ([by] if by else []) + ["session_date"]
    rows = orders.select(*([by] if by else []), F.col("o_orderdate").cast("date").alias("session_date"), "o_orderkey", F.col("o_totalprice").cast("double").alias("p"))
    out = rows.groupBy(*keys).agg(F.min_by("p", "o_orderkey").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o_orderkey").alias("close"), F.count("*").alias("volume"))
    return out.withColumn("expected", F.weekday("session_date") < 5).withColumn("usable", F.col("expected") & (F.col("volume") > 0))

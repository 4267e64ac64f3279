"""Features of a bar that are known when it closes: returns, volatility, ranges, levels, and gates by availability."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import WINDOWS
from tidemark.functions import clock, numbers

SESSION = ("session_date",)


def at(keys=SESSION):
    return W.partitionBy(*keys).orderBy("ts")


def trailing(n: int, keys=SESSION):
    return at(keys).rowsBetween(1 - n, 0)


def returns(bars: DataFrame, lags=WINDOWS.lags, keys=SESSION) -> DataFrame:
    """bar_return_n against the close n rows before, and log_return of one row."""
    out = bars.withColumns({f"bar_return_{n}": numbers.change(F.col("close"), F.lag("close", n).over(at(keys))) for n in lags})
    return out.withColumn("log_return", numbers.known(F.log(numbers.ratio(F.col("close"), F.lag("close").over(at(keys))))))


def realized_vol(bars: DataFrame, windows=WINDOWS.vol, keys=SESSION) -> DataFrame:
    """The deviation of n log returns, if all n are known. Needs log_return, itself a window: a second level of the plan on the same partitioning."""
    return bars.withColumns({f"realized_vol_{n}": F.when(F.count("log_return").over(trailing(n, keys)) == n, F.stddev_samp("log_return").over(trailing(n, keys))) for n in windows})


def rolling_range(bars: DataFrame, windows=WINDOWS.ranges, keys=SESSION) -> DataFrame:
    return bars.withColumns({f"rolling_range_{n}": F.when(F.count("high").over(trailing(n, keys)) == n, F.max("high").over(trailing(n, keys)) - F.min("low").over(trailing(n, keys))) for n in windows})


def so_far(bars: DataFrame, keys=SESSION) -> DataFrame:
    """High, low, range and volume of the session up to this bar, and minutes since its first observed one."""
    upto = at(keys).rowsBetween(W.unboundedPreceding, 0)
    out = bars.withColumns({"session_high_so_far": F.max("high").over(upto), "session_low_so_far": F.min("low").over(upto), "session_cumulative_volume": F.sum("total_volume").over(upto)})
    return out.withColumn("session_range_so_far", F.col("session_high_so_far") - F.col("session_low_so_far")).withColumn("session_minute", F.timestamp_diff("MINUTE", F.min("ts").over(W.partitionBy(*keys)), F.col("ts")))


def available(value: Column, known_at: Column, bar_at: Column) -> Column:
    """The value from the moment on at which it was known."""
    return F.when(bar_at >= known_at, value)


def gated(bars: DataFrame, families: Mapping[str, list[str]], bar_at: str = "bar_available_at") -> DataFrame:
    """Masks each column of a family until its availability column (the mapping's key) has passed."""
    return bars.withColumns({c: available(F.col(c), F.col(known), F.col(bar_at)) for known, cols in families.items() for c in cols})


def with_sessions(bars: DataFrame, sessions: DataFrame, rows: int = 100_000) -> DataFrame:
    """Bars with their session's columns. The session table has a row a day and is broadcast if it is found that small."""
    few = sessions.limit(rows + 1).count() <= rows
    return bars.join(F.broadcast(sessions) if few else sessions, "session_date")


def levels(bars: DataFrame, valid: str, high: str, low: str, close: str, name: str) -> DataFrame:
    """Distances of the close to a reference's levels, its place in their range, and flags that are null where the reference isn't valid."""
    c = F.col("close")
    return bars.withColumns({
        f"close_minus_{name}_high": c - F.col(high), f"close_minus_{name}_low": c - F.col(low), f"close_minus_{name}_close": c - F.col(close),
        f"close_vs_{name}_range": numbers.ratio(c - F.col(close), F.col(high) - F.col(low)),
        f"above_{name}_high": F.when(F.col(valid), c > F.col(high)), f"below_{name}_low": F.when(F.col(valid), c < F.col(low)),
    })


def with_segment(bars: DataFrame) -> DataFrame:
    return bars.withColumn("session_segment", clock.segment(F.col("rth_minute")))


def violations(bars: DataFrame, families: Mapping[str, list[str]], bar_at: str = "bar_available_at") -> DataFrame:
    """How often any feature of a family is there before it could be known: one pass, a column for each family."""
    early = lambda known, cols: (F.col(known) > F.col(bar_at)) & F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in cols], F.lit(False))
    return bars.agg(F.count("*").alias("rows"), *[F.count_if(early(k, cols)).alias(f"early_{k}") for k, cols in families.items()])

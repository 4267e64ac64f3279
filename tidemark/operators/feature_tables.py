"""The two feature tables: one row a session, and one row a bar with all that is known when it closes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import WINDOWS, Windows
from tidemark.functions import numbers

from . import bar_features as bf
from . import session_features as sf

OHLCV = ("open", "high", "low", "close", "volume")


def _minutes(at: Column, n) -> Column:
    return F.timestamp_add("MINUTE", n if isinstance(n, Column) else F.lit(n), at)


def _derived(df: DataFrame, name: str) -> DataFrame:
    return df.withColumns({f"{name}_range": F.col(f"{name}_high") - F.col(f"{name}_low"), f"{name}_return": numbers.change(F.col(f"{name}_close"), F.col(f"{name}_open"))})


def session_table(bars: DataFrame, schedule: DataFrame, usable: DataFrame, bar_minutes: int = 1, w: Windows = WINDOWS) -> DataFrame:
    """bars (labelled), schedule (as the calendar gives it), usable (session_date, usable) -> all session features.

    Every scheduled session has a row, usable or not, so that the session before is never skipped.
    """
    agg = sf.session_aggregate(bars, w.opening)
    out = schedule.join(agg, "session_date", "left").join(usable, "session_date", "left")
    out = out.withColumns({"usable": F.coalesce("usable", F.lit(False)), "expected": F.lit(True), "calendar_available_at_utc": F.col("open_utc")})
    at = sf.in_order()
    lag = lambda c: F.lag(c).over(at)
    out = out.withColumns({"prior_session_valid": F.coalesce(lag("usable") & lag("expected"), F.lit(False)), "prior_session_available_at_utc": lag("close_utc")})
    out = out.withColumns({f"prior_{s}_{c}": F.when(F.col("prior_session_valid"), lag(f"{s}_{c}")) for s in ("full", "rth") for c in OHLCV})
    out = _derived(_derived(out, "prior_full"), "prior_rth")

    until = F.least("rth_open_utc", "close_utc")
    whole = F.col("overnight_bars") == F.timestamp_diff("MINUTE", F.col("open_utc"), until) / bar_minutes
    out = out.withColumns({"overnight_available_at_utc": until, "overnight_valid": F.coalesce(F.col("usable") & F.col("prior_session_valid") & whole & F.col("overnight_open").isNotNull(), F.lit(False))})
    own = F.col("overnight_valid")
    out = out.withColumns({f"overnight_{c}": F.when(own, F.col(f"overnight_{c}")) for c in OHLCV})
    out = _derived(out, "overnight").withColumns({
        "overnight_gap_from_prior_rth": F.when(own, numbers.change(F.col("overnight_close"), F.col("prior_rth_close"))), "rth_open_gap_from_prior_rth": F.when(own, numbers.change(F.col("rth_open"), F.col("prior_rth_close"))),
    })
    for n in w.opening:
        name = f"opening_{n}"
        ends = _minutes(F.col("rth_open_utc"), n)
        valid = F.col("usable") & (F.col("close_utc") >= ends) & (F.col(f"{name}_bars") == n // bar_minutes) & F.col(f"{name}_open").isNotNull()
        out = out.withColumns({f"{name}_valid": F.coalesce(valid, F.lit(False)), f"{name}_available_at_utc": ends})
        out = _derived(out.withColumns({f"{name}_{c}": F.when(F.col(f"{name}_valid"), F.col(f"{name}_{c}")) for c in OHLCV}), name)

    regimes = sf.lagged_regimes(out.select("session_date", "usable", *[F.col(f"rth_{c}").alias(c) for c in OHLCV]), w)
    long, short = w.regime_long, w.regime_short
    names = {"range_mean": f"lagged_rth_range_mean_{long}", "range_std": f"lagged_rth_range_std_{long}", "volume_mean": f"lagged_rth_volume_mean_{long}", "short_return": f"lagged_close_return_{short}", "volatility_ratio": "lagged_volatility_ratio", "volume_ratio": "lagged_volume_ratio"}
    regimes = regimes.select("session_date", "regime_valid", *[F.col(a).alias(b) for a, b in names.items()], "trend_regime", "volatility_regime", "volume_regime")
    out = out.join(regimes, "session_date").withColumn("regime_available_at_utc", F.when(F.col("regime_valid"), F.col("prior_session_available_at_utc")))
    month = out.select("session_date", (F.col("session_date") == F.max("session_date").over(W.partitionBy(F.trunc("session_date", "month")))).alias("calendar_is_month_end_session"))
    return sf.calendar_parts(out).join(month, "session_date")


def bar_table(bars: DataFrame, sessions: DataFrame, bar_minutes: int = 1, w: Windows = WINDOWS) -> DataFrame:
    """bars (labelled) of usable sessions with every feature, each masked until it is known. One shuffle by session serves all windows."""
    out = bf.with_sessions(bars.select("ts", "session_date", *("open", "high", "low", "close"), "total_volume", "is_rth"), sessions.where("usable"))
    # the session's own prices have the names of the bar's
    out = out.withColumns({"timestamp_utc": F.col("ts"), "bar_available_at_utc": _minutes(F.col("ts"), bar_minutes), "rth_minute": F.timestamp_diff("MINUTE", F.col("rth_open_utc"), F.col("ts")).cast("int")})
    out = bf.with_segment(bf.so_far(bf.rolling_range(bf.realized_vol(bf.returns(out, w.lags), w.vol), w.ranges))).withColumn("session_minute", F.col("session_minute").cast("int"))
    masked = {"overnight_available_at_utc": ["overnight_valid", *[f"overnight_{c}" for c in (*OHLCV, "range", "return", "gap_from_prior_rth")], "rth_open_gap_from_prior_rth"]}
    for n in w.opening:
        masked[f"opening_{n}_available_at_utc"] = [f"opening_{n}_{c}" for c in ("valid", *OHLCV, "range", "return")]
    out = bf.gated(out, masked, "bar_available_at_utc")
    c = F.col("close")
    # before it is known, or if it isn't valid, a level is null, and so is all that is compared with it
    return out.withColumns({
        **{f"close_minus_prior_rth_{x}": c - F.col(f"prior_rth_{x}") for x in ("high", "low", "close")}, **{f"close_minus_{s}_{x}": c - F.col(f"{s}_{x}") for s in ("overnight", "opening_30") for x in ("high", "low")},
        "close_vs_prior_rth_range": numbers.ratio(c - F.col("prior_rth_close"), F.col("prior_rth_range")),
        "above_prior_rth_high": F.when(F.col("prior_session_valid"), c > F.col("prior_rth_high")), "below_prior_rth_low": F.when(F.col("prior_session_valid"), c < F.col("prior_rth_low")),
        "above_overnight_high": F.when(F.col("overnight_valid"), c > F.col("overnight_high")), "below_overnight_low": F.when(F.col("overnight_valid"), c < F.col("overnight_low")),
    })

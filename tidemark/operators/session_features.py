"""Session aggregates in one pass, and features of a session that are known when it begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import WINDOWS, Windows
from tidemark.functions import numbers


def slice_of(name: str, where: Column | None, ticks: bool = False) -> list[Column]:
    """Bars, open, high, low, close and volume of the bars that a condition holds for."""
    when = lambda c: c if where is None else F.when(where, c)
    at = when(F.col("ts"))
    out = [
        F.count(at).alias(f"{name}_bars"), F.min_by("open", at).alias(f"{name}_open"), F.max(when(F.col("high"))).alias(f"{name}_high"),
        F.min(when(F.col("low"))).alias(f"{name}_low"), F.max_by("close", at).alias(f"{name}_close"), F.sum(when(F.col("total_volume"))).alias(f"{name}_volume"),
    ]
    return out + ([F.sum(when(F.col("total_ticks"))).alias(f"{name}_ticks")] if ticks else [])


def session_aggregate(bars: DataFrame, opening: tuple[int, ...] = WINDOWS.opening, by: tuple[str, ...] = ()) -> DataFrame:
    """Labelled bars by session, and by `by`: the whole, overnight, regular and opening slices in one aggregation."""
    parts = slice_of("full", None, True) + slice_of("overnight", F.col("rth_minute") < 0) + slice_of("rth", F.col("is_rth"), True)
    for w in opening:
        parts += slice_of(f"opening_{w}", F.col("is_rth") & (F.col("rth_minute") < w))
    return bars.groupBy(*by, "session_date").agg(*parts)


def opening_windows(sessions: DataFrame, bar_minutes: int, opening: tuple[int, ...] = WINDOWS.opening) -> DataFrame:
    """Masks each opening window unless it has all its bars; adds its range and return."""
    out = sessions
    for w in opening:
        n = f"opening_{w}"
        valid = F.coalesce((F.col(f"{n}_bars") == w // bar_minutes) & F.col(f"{n}_open").isNotNull(), F.lit(False))
        out = out.withColumn(f"{n}_valid", valid)
        out = out.withColumns({f"{n}_{c}": F.when(F.col(f"{n}_valid"), F.col(f"{n}_{c}")) for c in ("open", "high", "low", "close", "volume")})
        out = out.withColumn(f"{n}_range", F.col(f"{n}_high") - F.col(f"{n}_low")).withColumn(f"{n}_return", numbers.change(F.col(f"{n}_close"), F.col(f"{n}_open")))
    return out


def in_order(by: tuple[str, ...] = (), day: str = "session_date"):
    """Sessions in order, of one series; a series has one row a day."""
    return W.partitionBy(*by).orderBy(day)


def prior_session(sessions: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close", "volume"), prefix: str = "prior", by: tuple[str, ...] = ()) -> DataFrame:
    """The values of the row before, if that session was expected and usable: an excluded one isn't skipped, it leaves null."""
    at = in_order(by)
    out = sessions.withColumn("prior_valid", F.coalesce(F.lag("usable").over(at) & F.lag("expected").over(at), F.lit(False)))
    out = out.withColumns({f"{prefix}_{c}": F.when(F.col("prior_valid"), F.lag(c).over(at)) for c in columns})
    return out.withColumn(f"{prefix}_range", F.col(f"{prefix}_high") - F.col(f"{prefix}_low")).withColumn(f"{prefix}_return", numbers.change(F.col(f"{prefix}_close"), F.col(f"{prefix}_open")))


def complete_mean(column: str, n: int, by: tuple[str, ...] = ()) -> Column:
    """The mean of the n rows before, if none of them lacks the value."""
    before = in_order(by).rowsBetween(-n, -1)
    return F.when(F.count(column).over(before) == n, F.avg(column).over(before))


def complete_std(column: str, n: int, by: tuple[str, ...] = ()) -> Column:
    before = in_order(by).rowsBetween(-n, -1)
    return F.when(F.count(column).over(before) == n, F.stddev_samp(column).over(before))


def lagged_regimes(sessions: DataFrame, windows: Windows = WINDOWS, by: tuple[str, ...] = ()) -> DataFrame:
    """Rolling range and volume of the sessions before, the short return, their ratios and labels.

    All nine are null unless this session is usable and the long means and the short return are known.
    """
    long, short, at = windows.regime_long, windows.regime_short, in_order(by)
    own = sessions.withColumn("_range", F.when(F.col("usable"), F.col("high") - F.col("low"))).withColumn("_volume", F.when(F.col("usable"), F.col("volume").cast("double")))
    run = F.sum(F.col("usable").cast("int")).over(at.rowsBetween(-short - 1, -1)) == short + 1
    own = own.withColumns({
        "range_mean": complete_mean("_range", long, by), "range_std": complete_std("_range", long, by), "volume_mean": complete_mean("_volume", long, by),
        "short_return": F.when(run, numbers.change(F.lag("close", 1).over(at), F.lag("close", short + 1).over(at))),
        "volatility_ratio": numbers.ratio(F.lag("_range").over(at), complete_mean("_range", long, by)), "volume_ratio": numbers.ratio(F.lag("_volume").over(at), complete_mean("_volume", long, by)),
    })
    own = own.withColumns({
        "trend_regime": numbers.trend(F.col("short_return"), windows.trend), "volatility_regime": numbers.regime(F.col("volatility_ratio"), windows.low, windows.high),
        "volume_regime": numbers.regime(F.col("volume_ratio"), windows.low, windows.high),
    })
    valid = F.col("usable") & F.col("range_mean").isNotNull() & F.col("volume_mean").isNotNull() & F.col("short_return").isNotNull()
    nine = ["range_mean", "range_std", "volume_mean", "short_return", "volatility_ratio", "volume_ratio", "trend_regime", "volatility_regime", "volume_regime"]
    return own.withColumn("regime_valid", F.coalesce(valid, F.lit(False))).withColumns({c: F.when(F.col("regime_valid"), F.col(c)) for c in nine}).drop("_range", "_volume")


def calendar_parts(sessions: DataFrame) -> DataFrame:
    d = F.col("session_date")
    return sessions.withColumns({"calendar_year": F.year(d), "calendar_quarter": F.quarter(d), "calendar_month": F.month(d), "calendar_iso_week": F.weekofyear(d), "calendar_weekday": F.weekday(d)})


def month_end(calendar: DataFrame) -> DataFrame:
    """Calendar days (session_date), to be extended past the data, with whether each is its month's last session."""
    last = calendar.groupBy(F.trunc("session_date", "month").alias("_m")).agg(F.max("session_date").alias("_last"))
    return calendar.join(F.broadcast(last), F.trunc("session_date", "month") == F.col("_m")).withColumn("is_month_end", F.col("session_date") == F.col("_last")).drop("_m", "_last")

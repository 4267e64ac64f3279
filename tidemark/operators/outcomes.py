"""Forward outcomes on a fixed clock, their summaries by clock cell, stability over cuts, and the timing of extremes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import clock, numbers

SESSION = ("session_date",)


def forward(bars: DataFrame, horizons: tuple[int, ...], bar_minutes: int = 1, step: int | None = None, minute: str = "clock", keys=SESSION, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each anchor bar and horizon (minutes) the entry at its open, the exit at the close of the horizon's last bar, and the best and worst on the way.

    The horizon's last bar must stand where it would without a gap. All horizons come from one shuffle and sort by session; each
    frame is as long as its horizon.
    """
    at = W.partitionBy(*keys).orderBy("ts")
    out = bars
    for h in horizons:
        n = h // bar_minutes
        ahead = at.rowsBetween(0, n - 1)
        whole = F.lead(minute, n - 1).over(at) == F.col(minute) + h - bar_minutes if n > 1 else F.lit(True)
        out = out.withColumn(f"_f{h}", F.when(whole & (F.col("open") > 0), F.struct(F.lead("close", n - 1).over(at).alias("exit"), F.max("high").over(ahead).alias("high"), F.min("low").over(ahead).alias("low"))))
    if step:
        out = out.where(F.col(minute) % step == 0)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"_f{h}").alias("f")) for h in horizons]))
    out = out.select(*keys, *keep, "ts", F.col(minute).alias("clock_minute"), "open", each.alias("_o")).where("_o.f IS NOT NULL")
    entry, f = F.col("open"), "_o.f."
    return out.select(
        *keys, *keep, "ts", "clock_minute", F.col("_o.h").alias("horizon_minutes"), (F.col(f + "exit") - entry).alias("return_points"), numbers.bps(F.col(f + "exit"), entry).alias("return_bps"),
        (F.col(f + "high") - entry).alias("mfe_points"), numbers.bps(F.col(f + "high"), entry).alias("mfe_bps"), (F.col(f + "low") - entry).alias("mae_points"), numbers.bps(F.col(f + "low"), entry).alias("mae_bps"),
    )


def scoped(bars: DataFrame, horizons: tuple[int, ...], bar_minutes: int = 1, step: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Outcomes of the whole session (ETH) and of regular hours alone (RTH)."""
    eth = forward(bars, horizons, bar_minutes, step, "clock", keep=keep).withColumn("scope", F.lit("ETH"))
    rth = forward(bars.where("is_rth"), horizons, bar_minutes, step, "rth_minute", keep=keep).withColumn("scope", F.lit("RTH"))
    return eth.unionByName(rth)


def summary(outcomes: DataFrame, keys: list[str], level: float = 0.95) -> DataFrame:
    """One row a group: counts, moments, quartiles, the share of rises with Wilson's interval, and the mean's t interval; one aggregation."""
    r = F.col("return_bps")
    got = outcomes.groupBy(*keys).agg(
        F.count(r).alias("n"), F.count_if(r > 0).alias("n_positive"), F.avg(r).alias("mean_bps"), F.percentile(r, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"), F.stddev_samp(r).alias("std_bps"),
        F.avg("return_points").alias("mean_points"), F.percentile("return_points", 0.5).alias("median_points"), F.avg("mfe_bps").alias("mean_mfe_bps"), F.percentile("mfe_bps", 0.5).alias("median_mfe_bps"),
        F.avg("mae_bps").alias("mean_mae_bps"), F.percentile("mae_bps", 0.5).alias("median_mae_bps"),
    )
    got = got.withColumns({"p25_bps": F.col("_q")[0], "median_bps": F.col("_q")[1], "p75_bps": F.col("_q")[2], "positive_rate": numbers.ratio(F.col("n_positive"), F.col("n"))}).drop("_q")
    low, high = numbers.wilson(F.col("n_positive"), F.col("n"), level)
    got = got.withColumns({"wilson_low": low, "wilson_high": high, "se_bps": F.col("std_bps") / F.sqrt(F.col("n").cast("double"))})
    return numbers.with_t_interval(got, "mean_bps", "std_bps", "n", level)


def cuts(outcomes: DataFrame, dimensions: list[str], cells: list[str]) -> DataFrame:
    """Each outcome once for each dimension, as cut_type and cut_value; a missing regime is unavailable. One pass, then one aggregation over all cuts."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("cut_type"), F.coalesce(F.col(d).cast("string"), F.lit("unavailable")).alias("cut_value")) for d in dimensions]))
    return outcomes.withColumn("_c", pairs).select(*cells, "return_bps", "return_points", "mfe_bps", "mae_bps", "_c.*")


def stability(outcomes: DataFrame, dimensions: list[str], cells: list[str], least: int = 30) -> DataFrame:
    return summary(cuts(outcomes, dimensions, cells), [*cells, "cut_type", "cut_value"]).withColumn("sample_sufficient", F.col("n") >= least)


def agreement(cut_summary: DataFrame, cells: list[str]) -> DataFrame:
    """How far the signs of a cell's means agree over the values of a cut; the majority is a tie if rises and falls are as many."""
    m = F.col("mean_bps")
    got = cut_summary.where("cut_value != 'unavailable'").groupBy(*cells, "cut_type").agg(
        F.count("*").alias("groups"), F.count_if(m > 0).alias("positive_groups"), F.count_if(m < 0).alias("negative_groups"), F.count_if(m == 0).alias("zero_groups"), F.min(m).alias("min_mean_bps"), F.max(m).alias("max_mean_bps")
    )
    p, n, z = (F.col(f"{x}_groups") for x in ("positive", "negative", "zero"))
    return got.withColumn("majority_sign", F.when((p > n) & (p > z), "positive").when((n > p) & (n > z), "negative").when((z > p) & (z > n), "zero").otherwise("tie")).withColumn("majority_share", F.greatest(p, n, z) / F.col("groups"))


def extremes(bars: DataFrame, minute: str = "clock", keys=SESSION) -> DataFrame:
    """When a session first reaches its high and low, its range, and where it closes in it."""
    ts = F.col("ts")
    got = bars.groupBy(*keys).agg(
        F.min_by(minute, F.struct(-F.col("high"), ts)).alias("high_minute"), F.min_by(minute, F.struct("low", ts)).alias("low_minute"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.min_by("open", ts).alias("open"), F.max_by("close", ts).alias("close"), F.count("*").alias("bars"),
    )
    return got.withColumns({"range_points": F.col("high") - F.col("low"), "high_first": F.col("high_minute") < F.col("low_minute"), "close_location": numbers.ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low"))})


def turning_bins(timing: DataFrame, minutes: int, last: int) -> DataFrame:
    """How many sessions have their high or low in each bin, empty bins too, with the share and Wilson's interval."""
    both = timing.select(F.expr("stack(2, 'high', high_minute, 'low', low_minute) AS (extreme, minute)")).withColumn("bin_start", (F.floor(F.col("minute") / minutes) * minutes).cast("int"))
    counts = both.groupBy("extreme", "bin_start").agg(F.count("*").alias("sessions"))
    total = timing.agg(F.count("*").alias("total"))
    bins = timing.sparkSession.sql(f"SELECT explode(sequence(0, {last - 1}, {minutes})) AS bin_start").withColumn("extreme", F.explode(F.array(F.lit("high"), F.lit("low"))))
    got = bins.join(counts, ["extreme", "bin_start"], "left").join(F.broadcast(total)).withColumn("sessions", F.coalesce("sessions", F.lit(0)))
    low, high = numbers.wilson(F.col("sessions"), F.col("total"))
    return got.withColumns({"share": numbers.ratio(F.col("sessions"), F.col("total")), "wilson_low": low, "wilson_high": high})


def blocks(clock_summary: DataFrame, picks: dict[str, tuple[int, int]]) -> DataFrame:
    """The cells that tile a scope without overlap: for each scope its horizon and step."""
    keep = F.lit(False)
    for scope, (horizon, step) in picks.items():
        keep |= (F.col("scope") == scope) & (F.col("horizon_minutes") == horizon) & (F.col("clock_minute") % step == 0)
    return clock_summary.where(keep).withColumn("label", clock.clock_label(F.col("scope"), F.col("clock_minute")))


def strongest(block_rows: DataFrame, value: str = "mean_bps") -> DataFrame:
    """For each scope the cells with the greatest and least value, the earliest of equal ones."""
    best = lambda sign: F.min_by(F.struct("clock_minute", "label", value), F.struct(sign * F.col(value), F.col("clock_minute")))
    got = block_rows.where(F.col(value).isNotNull()).groupBy("scope").agg(best(-1).alias("strongest"), best(1).alias("weakest"))
    return got.select("scope", F.expr(f"stack(2, 'strongest', strongest.clock_minute, strongest.label, strongest.{value}, 'weakest', weakest.clock_minute, weakest.label, weakest.{value}) AS (kind, clock_minute, label, {value})"))


def modal_bin(bins: DataFrame) -> DataFrame:
    """For each extreme the bin with the greatest share, the first of equal ones."""
    return bins.groupBy("extreme").agg(F.min_by(F.struct("bin_start", "sessions", "share"), F.struct(-F.col("share"), F.col("bin_start"))).alias("b")).select("extreme", "b.*")


def sign(c: Column) -> Column:
    return F.signum(c).cast("int")

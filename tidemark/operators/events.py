"""Event studies: hypotheses from settings, the events they select, and what follows them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import INFERENCE
from tidemark.config import SESSION as SPEC
from tidemark.functions import clock, numbers

SESSION = ("session_date",)


def hypotheses(spark: SparkSession, families: Sequence[dict]) -> DataFrame:
    """One row for each test, made from settings on the driver: hypothesis_id, family_id, kind, horizon_minutes, entry_minute, reference, threshold, null.

    fixed_clock: anchors x horizons, named by their clocks in regular hours. directional: feature, least absolute bps, horizons. range_break:
    references (none: one without a name), horizons. volatility_state and pressure: horizons. `null` is how a p value comes about: signs flipped for fixed
    clocks, states permuted for volatility states, directions permuted for all others.
    """
    label = lambda m: f"{(SPEC.rth_open + m) // 60 % 24:02d}{(SPEC.rth_open + m) % 60:02d}"
    rows = []
    for f in families:
        null = {"fixed_clock": "sign_flip", "volatility_state": "state"}.get(f["kind"], "direction")
        for h in f["horizons"]:
            for a in f.get("anchors", [f.get("anchor")]):
                for r in f.get("references", [None]):
                    tail = f"{label(a)}_{label(a + h)}" if f["kind"] == "fixed_clock" else f"{r}__{h}m" if r else f"{h}m"
                    rows.append((f"{f['family']}__{tail}", f["family"], f["kind"], h, a, r, f.get("threshold"), null))
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("names of hypotheses repeat")
    return spark.createDataFrame(rows, "hypothesis_id string, family_id string, kind string, horizon_minutes int, entry_minute int, reference string, threshold double, null string")


def fixed_clock(outcomes: DataFrame, family: str, anchors: list[int], horizon: int, scope: str = "RTH") -> DataFrame:
    """The outcome at each anchor of each session, named by its clocks in the scope; the effect is the return itself."""
    got = outcomes.where(F.col("clock_minute").isin(anchors) & (F.col("horizon_minutes") == horizon))
    hhmm = lambda m: F.replace(clock.clock_label(F.lit(scope), m), F.lit(":"), F.lit(""))
    return got.select(F.concat(F.lit(f"{family}__"), hhmm(F.col("clock_minute")), F.lit("_"), hhmm(F.col("clock_minute") + horizon)).alias("hypothesis_id"), "session_date", F.col("clock_minute").alias("entry_minute"), F.lit(1).alias("direction"), "return_bps", F.col("return_bps").alias("effect_bps"))


def directional(outcomes: DataFrame, signals: DataFrame, family: str, entry: int, horizons: list[int], least_bps: float) -> DataFrame:
    """signals (session_date, signal as a ratio, valid): sessions with a signal of at least so many bps; the effect is the return in its direction."""
    s = signals.where(F.col("valid") & (F.abs(F.col("signal") * 1e4) >= least_bps) & (F.col("signal") != 0)).select("session_date", "signal")
    got = outcomes.where((F.col("clock_minute") == entry) & F.col("horizon_minutes").isin(horizons)).join(s, "session_date")
    way = F.signum("signal").cast("int")
    return got.select(F.concat(F.lit(f"{family}__"), F.col("horizon_minutes").cast("string"), F.lit("m")).alias("hypothesis_id"), "session_date", F.col("clock_minute").alias("entry_minute"), way.alias("direction"), "return_bps", (way * F.col("return_bps")).alias("effect_bps"))


def first_break(bars: DataFrame, upper: str, lower: str, bar_minutes: int, horizon: int, between: tuple[int, int], minute: str = "rth_minute", keys=SESSION) -> DataFrame:
    """The first bar of a session that closes beyond its reference range, the upper bound tried first, and what follows the entry on the next bar.

    Bars without known bounds are passed over. If the bar after the first break is missing, or the horizon has a gap, the
    session has no event: there is no second search.
    """
    at = W.partitionBy(*keys).orderBy("ts")
    n = horizon // bar_minutes
    ahead = at.rowsBetween(1, n)
    own = bars.withColumns({
        "_entry": F.lead("open", 1).over(at), "_next": F.lead(minute, 1).over(at), "_last": F.lead(minute, n).over(at), "_exit": F.lead("close", n).over(at), "_high": F.max("high").over(ahead), "_low": F.min("low").over(ahead),
        "direction": F.when(F.col("close") > F.col(upper), 1).when(F.col("close") < F.col(lower), -1),
    })
    hit = own.where(F.col(upper).isNotNull() & F.col(lower).isNotNull() & F.col("direction").isNotNull() & F.col(minute).between(*between))
    first = hit.withColumn("_r", F.row_number().over(at)).where("_r = 1")
    first = first.where((F.col("_next") == F.col(minute) + bar_minutes) & (F.col("_last") == F.col(minute) + horizon) & (F.col("_entry") > 0))
    r = numbers.bps(F.col("_exit"), F.col("_entry"))
    return first.select(*keys, F.col(minute).alias("trigger_minute"), F.col("_next").alias("entry_minute"), "direction", r.alias("return_bps"), (F.col("direction") * r).alias("effect_bps"), numbers.bps(F.col("_high"), F.col("_entry")).alias("mfe_bps"), numbers.bps(F.col("_low"), F.col("_entry")).alias("mae_bps"))


def lagged_quantiles(rows: DataFrame, value: str, by: str, quantiles: dict[str, float], history: int = INFERENCE.history, least: int = INFERENCE.min_history, day: str = "session_date") -> DataFrame:
    """Exact quantiles of the same clock's values over the `history` sessions before, this one left out; null below `least` known ones.

    A session whose value is null takes a place in the history but doesn't count.
    """
    before = W.partitionBy(by).orderBy(day).rowsBetween(-history, -1)
    out = rows.withColumn(f"{value}_history", F.count(value).over(before))
    return out.withColumns({name: F.when(F.col(f"{value}_history") >= least, F.percentile(value, q).over(before)) for name, q in quantiles.items()})


def contiguous_forward(bars: DataFrame, bar_minutes: int, horizon: int, minute: str = "rth_minute", keys=SESSION) -> DataFrame:
    """At each bar the entry at its open and the range, return and extremes of the horizon; null unless every bar of it is there with a positive price."""
    ahead = W.partitionBy(*keys).orderBy(F.col(minute)).rangeBetween(0, horizon - bar_minutes)
    whole = (F.count("*").over(ahead) == horizon // bar_minutes) & (F.min("low").over(ahead) > 0)
    entry, last = F.col("open"), F.last("close").over(ahead)
    return bars.withColumns({
        "fwd_return_bps": F.when(whole, numbers.bps(last, entry)), "fwd_range_bps": F.when(whole, (F.max("high").over(ahead) - F.min("low").over(ahead)) / entry * 1e4),
        "fwd_mfe_bps": F.when(whole, numbers.bps(F.max("high").over(ahead), entry)), "fwd_mae_bps": F.when(whole, numbers.bps(F.min("low").over(ahead), entry)),
    })


def volatility_states(bars: DataFrame, value: str, bar_minutes: int, entries: list[int], horizon: int, minute: str = "rth_minute", history: int = INFERENCE.history, least: int = INFERENCE.min_history, low: float = INFERENCE.low_q, high: float = INFERENCE.high_q) -> DataFrame:
    """Bars just before the entries whose volatility is low or high against the same clock's history; the effect is the range that follows."""
    ahead = contiguous_forward(bars, bar_minutes, horizon, minute).select("session_date", F.col(minute).alias("_entry"), "fwd_range_bps")
    triggers = bars.where((F.col(minute) + bar_minutes).isin(entries)).withColumn("entry_minute", F.col(minute) + bar_minutes)
    q = lagged_quantiles(triggers, value, minute, {"q_low": low, "q_high": high}, history, least)
    state = F.when(F.col(value) <= F.col("q_low"), "low").when(F.col(value) >= F.col("q_high"), "high")
    q = q.withColumn("state", state).where("state IS NOT NULL")
    got = q.alias("q").join(ahead.alias("f"), (F.col("q.session_date") == F.col("f.session_date")) & (F.col("entry_minute") == F.col("_entry"))).where("fwd_range_bps IS NOT NULL")
    return got.select("q.session_date", "entry_minute", "state", F.col(value).alias("value"), "q_low", "q_high", F.col("fwd_range_bps").alias("effect_bps"))


def pressure(bars: DataFrame, n: int = INFERENCE.trailing, keys=SESSION) -> DataFrame:
    """Signed pressure and activity of the last n bars: (up - down) / (up + down) volume; null without n bars or activity."""
    w = W.partitionBy(*keys).orderBy("ts").rowsBetween(1 - n, 0)
    full = F.count("up_volume").over(w) == n
    out = bars.withColumns({"activity": F.when(full, F.sum(F.col("up_volume") + F.col("down_volume")).over(w)), "_net": F.when(full, F.sum(F.col("up_volume") - F.col("down_volume")).over(w))})
    return out.withColumn("pressure", F.when(F.col("activity") > 0, F.col("_net") / F.col("activity"))).withColumn("abs_pressure", F.abs("pressure")).drop("_net")


def first_bursts(bars: DataFrame, bar_minutes: int, horizon: int, between: tuple[int, int], n: int = INFERENCE.trailing, minute: str = "rth_minute", history: int = INFERENCE.history, least: int = INFERENCE.min_history, pressure_q: float = INFERENCE.pressure_q, activity_q: float = INFERENCE.activity_q) -> DataFrame:
    """The first bar of a session with extreme pressure at sufficient activity, both against the same clock's history, and the return that follows the entry on the next bar in the pressure's direction."""
    own = contiguous_forward(pressure(bars, n), bar_minutes, horizon, minute)
    at = W.partitionBy("session_date").orderBy("ts")
    own = own.withColumns({"_next": F.lead(minute).over(at), "_fwd": F.lead("fwd_return_bps").over(at)}).where(F.col(minute).between(*between))
    own = lagged_quantiles(own, "abs_pressure", minute, {"q_pressure": pressure_q}, history, least)
    own = lagged_quantiles(own, "activity", minute, {"q_activity": activity_q}, history, least)
    hit = own.where((F.col("abs_pressure") >= F.col("q_pressure")) & (F.col("activity") >= F.col("q_activity")) & (F.col("pressure") != 0))
    first = hit.withColumn("_r", F.row_number().over(at)).where("_r = 1").where((F.col("_next") == F.col(minute) + bar_minutes) & F.col("_fwd").isNotNull())
    way = F.signum("pressure").cast("int")
    return first.select("session_date", F.col(minute).alias("trigger_minute"), F.col("_next").alias("entry_minute"), way.alias("direction"), "pressure", "q_pressure", "activity", "q_activity", F.col("_fwd").alias("return_bps"), (way * F.col("_fwd")).alias("effect_bps"))


def year_stability(events: DataFrame) -> DataFrame:
    e = F.col("effect_bps")
    return events.groupBy("hypothesis_id", F.year("session_date").alias("calendar_year")).agg(F.count("*").alias("n"), F.avg(e).alias("mean_bps"), F.percentile(e, 0.5).alias("median_bps"), F.avg((e > 0).cast("double")).alias("positive_rate"))


def state_contrast(events: DataFrame, keys: list[str]) -> DataFrame:
    """The mean effect of the high state less that of the low one; null if either is empty."""
    of = lambda s: F.when(F.col("state") == s, F.col("effect_bps"))
    return events.groupBy(*keys).agg(F.count(of("high")).alias("n_high"), F.count(of("low")).alias("n_low"), (F.avg(of("high")) - F.avg(of("low"))).alias("difference_bps"))


def state_ranges(events: DataFrame) -> DataFrame:
    return events.groupBy("state").agg(F.count("*").alias("n"), F.countDistinct("session_date").alias("sessions"), F.avg("effect_bps").alias("mean_bps"), F.percentile("effect_bps", 0.5).alias("median_bps"))


def family_summary(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("family_id").agg(F.count("*").alias("tests"), F.count_if("bh_reject").alias("rejected"), F.min("p_value").alias("min_p"), F.min("q_value").alias("min_q"), F.min("n").alias("min_n"), F.max("n").alias("max_n"))


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def labels(ledger: DataFrame) -> DataFrame:
    """The readable name of each hypothesis: its horizon by pattern, its family by a map that keeps unknown names."""
    return ledger.withColumn("horizon", F.coalesce(F.nullif(F.regexp_extract("hypothesis_id", r"__(\d+)m$", 1), F.lit("")).cast("int"), "horizon_minutes")).withColumn("entry_label", F.when(F.col("entry_minute").isNotNull(), clock.clock_label(F.lit("RTH"), F.col("entry_minute"))))

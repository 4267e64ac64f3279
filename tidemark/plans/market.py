"""Bars, their features, forward outcomes and what summarises them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import clock, numbers
from tidemark.operators import bar_features as bf
from tidemark.operators import outcomes as oc
from tidemark.operators import session_features as sf
from tidemark.sources import adapters

from .base import Catalogue, all_bars, b, bars, bars_sql, events, r, s, t

C = Catalogue()
BARS15, BARS60 = bars_sql(15), bars_sql(60)
OHLC = f"{r('open')}, {r('high')}, {r('low')}, {r('close')}"
RAW = f"{t('ts')}, {OHLC}, up_volume, down_volume, up_ticks, down_ticks, total_volume, total_ticks"


@C.add(f"WITH {BARS15} SELECT {RAW} FROM raw_bars")
def bars_15m(spark, d):
    return adapters.bars_from_events(events(spark, d), 15)


@C.add(f"WITH {BARS60} SELECT {RAW} FROM raw_bars")
def bars_60m(spark, d):
    return adapters.bars_from_events(events(spark, d), 60)


@C.add(f"WITH {bars_sql(60, 'event_type')} SELECT event_type, {RAW} FROM raw_bars")
def bars_by_type(spark, d):
    return adapters.bars_from_events(events(spark, d, "event_type"), 60, "event_type")


@C.add(f"WITH {BARS15} SELECT {t('ts')}, {s('session_date')}, clock, rth_minute, is_rth, clock < 1380 AND isodow(session_date) < 6 AS in_session, CASE WHEN rth_minute < 0 THEN 'overnight' WHEN rth_minute < 30 THEN 'rth_opening' WHEN rth_minute < 150 THEN 'rth_morning' WHEN rth_minute < 390 THEN 'rth_afternoon' ELSE 'post_rth' END AS session_segment FROM all_bars")
def session_labels(spark, d):
    return bf.with_segment(all_bars(spark, d)).select("ts", "session_date", "clock", "rth_minute", "is_rth", "in_session", "session_segment")


@C.add("""
SELECT event_id, CAST(date_diff('minute', ts, l) AS BIGINT) AS utc_offset_minutes, strftime(l, '%Y-%m-%dT%H:%M:%S') || '-05:00' AS timestamp_et,
  printf('%02d:%02d', hour(l), minute(l)) AS clock_label, CASE WHEN CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-18' THEN 'development' WHEN CAST(ts AS DATE) BETWEEN DATE '2024-01-19' AND DATE '2024-01-24' THEN 'validation' ELSE 'outside_research' END AS split
FROM (SELECT event_id, ts, timezone('America/New_York', timezone('UTC', ts)) AS l FROM events)""")
def local_clock(spark, d):
    ts = F.col("ts")
    minute = F.pmod(clock.local_minute(ts) - 1080, F.lit(1440))
    splits = [("development", "2024-01-01", "2024-01-18"), ("validation", "2024-01-19", "2024-01-24")]
    return events(spark, d).select("event_id", clock.utc_offset_minutes(ts).alias("utc_offset_minutes"), clock.iso_local(ts).alias("timestamp_et"), clock.clock_label(F.lit("ETH"), minute).alias("clock_label"), clock.split_label(F.to_date(ts), splits).alias("split"))


def _slice_sql(n: str, where: str, ticks: bool = False) -> str:
    f = f"FILTER (WHERE {where})"
    out = f"count(*) {f} AS {n}_bars, first(open ORDER BY ts) {f} AS {n}_open, max(high) {f} AS {n}_high, min(low) {f} AS {n}_low, last(close ORDER BY ts) {f} AS {n}_close, sum(total_volume) {f} AS {n}_volume"
    return out + (f", sum(total_ticks) {f} AS {n}_ticks" if ticks else "")


AGG = f"SELECT session_date, {_slice_sql('full', 'true', True)}, {_slice_sql('overnight', 'rth_minute < 0')}, {_slice_sql('rth', 'is_rth', True)}, {_slice_sql('opening_30', 'is_rth AND rth_minute < 30')}, {_slice_sql('opening_60', 'is_rth AND rth_minute < 60')} FROM bars GROUP BY session_date"
_cells = [f"{n}_{c}" for n in ("full", "overnight", "rth", "opening_30", "opening_60") for c in ("open", "high", "low", "close")]
_counts = [f"{n}_{c}" for n in ("full", "overnight", "rth", "opening_30", "opening_60") for c in ("bars", "volume")] + ["full_ticks", "rth_ticks"]


@C.add(f"WITH {BARS15}, a AS ({AGG}) SELECT {s('session_date')}, {', '.join(map(r, _cells))}, {', '.join(b(f'coalesce({c}, 0)', c) for c in _counts)} FROM a")
def session_aggregate(spark, d):
    return sf.session_aggregate(bars(spark, d), (30, 60)).fillna(0, _counts)


def _open_sql(w: int) -> str:
    v = f"coalesce(opening_{w}_bars = {w // 15} AND opening_{w}_open IS NOT NULL, false)"
    cells = ", ".join(r(f"CASE WHEN {v} THEN opening_{w}_{c} END", f"opening_{w}_{c}") for c in ("open", "high", "low", "close"))
    return f"{v} AS opening_{w}_valid, {cells}, {r(f'CASE WHEN {v} THEN opening_{w}_high - opening_{w}_low END', f'opening_{w}_range')}, {r(f'CASE WHEN {v} THEN opening_{w}_close / nullif(opening_{w}_open, 0) - 1 END', f'opening_{w}_return')}"


@C.add(f"WITH {BARS15}, a AS ({AGG}) SELECT {s('session_date')}, {_open_sql(30)}, {_open_sql(60)} FROM a")
def opening_windows(spark, d):
    got = sf.opening_windows(sf.session_aggregate(bars(spark, d), (30, 60)), 15, (30, 60))
    return got.select("session_date", *[f"opening_{w}_{c}" for w in (30, 60) for c in ("valid", "open", "high", "low", "close", "range", "return")])


@C.add(f"""WITH {BARS15}, x AS (
  SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS r1, close / nullif(lag(close, 2) OVER w, 0) - 1 AS r2, close / nullif(lag(close, 4) OVER w, 0) - 1 AS r4,
    ln(nullif(close / nullif(lag(close) OVER w, 0), 0)) AS lr FROM bars WINDOW w AS (PARTITION BY session_date ORDER BY ts))
SELECT {t('ts')}, {r('r1', 'bar_return_1')}, {r('r2', 'bar_return_2')}, {r('r4', 'bar_return_4')}, {r('lr', 'log_return')} FROM x""")
def bar_returns(spark, d):
    return bf.returns(bars(spark, d), (1, 2, 4)).select("ts", "bar_return_1", "bar_return_2", "bar_return_4", "log_return")


@C.add(f"""WITH {BARS15}, x AS (SELECT *, ln(nullif(close / nullif(lag(close) OVER (PARTITION BY session_date ORDER BY ts), 0), 0)) AS lr FROM bars)
SELECT {t('ts')}, {r('CASE WHEN count(lr) OVER w4 = 4 THEN stddev_samp(lr) OVER w4 END', 'realized_vol_4')}, {r('CASE WHEN count(lr) OVER w8 = 8 THEN stddev_samp(lr) OVER w8 END', 'realized_vol_8')}
FROM x WINDOW w4 AS (PARTITION BY session_date ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), w8 AS (PARTITION BY session_date ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
def realized_vol(spark, d):
    return bf.realized_vol(bf.returns(bars(spark, d), (1,)), (4, 8)).select("ts", "realized_vol_4", "realized_vol_8")


@C.add(f"""WITH {BARS15} SELECT {t('ts')}, {r('CASE WHEN count(*) OVER w = 4 THEN max(high) OVER w - min(low) OVER w END', 'rolling_range_4')},
  {r('max(high) OVER c', 'session_high_so_far')}, {r('min(low) OVER c', 'session_low_so_far')}, {r('max(high) OVER c - min(low) OVER c', 'session_range_so_far')}, {b('sum(total_volume) OVER c', 'session_cumulative_volume')},
  CAST(date_diff('minute', min(ts) OVER (PARTITION BY session_date), ts) AS BIGINT) AS session_minute
FROM bars WINDOW w AS (PARTITION BY session_date ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), c AS (PARTITION BY session_date ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def ranges_so_far(spark, d):
    got = bf.so_far(bf.rolling_range(bars(spark, d), (4,)))
    return got.select("ts", "rolling_range_4", "session_high_so_far", "session_low_so_far", "session_range_so_far", "session_cumulative_volume", "session_minute")


def _sessions(spark, d):
    """Sessions of the bars with the regular hours of the one before, and when opening_30 is known."""
    agg = sf.session_aggregate(bars(spark, d), (30,)).withColumn("expected", F.lit(True)).withColumn("usable", F.col("rth_bars") == 26)
    renamed = agg.select("session_date", "expected", "usable", *[F.col(f"rth_{c}").alias(c) for c in ("open", "high", "low", "close", "volume")], "opening_30_bars", "opening_30_high", "opening_30_low")
    return sf.prior_session(renamed, prefix="prior_rth").drop("open", "high", "low", "close", "volume")


PRIOR = f"""a AS (
  SELECT session_date, count(*) FILTER (WHERE is_rth) AS rth_bars, first(open ORDER BY ts) FILTER (WHERE is_rth) AS open, max(high) FILTER (WHERE is_rth) AS high, min(low) FILTER (WHERE is_rth) AS low, last(close ORDER BY ts) FILTER (WHERE is_rth) AS close,
    max(high) FILTER (WHERE is_rth AND rth_minute < 30) AS o_high, min(low) FILTER (WHERE is_rth AND rth_minute < 30) AS o_low FROM bars GROUP BY session_date),
p AS (
  SELECT session_date, o_high, o_low, coalesce(lag(rth_bars = 26) OVER w, false) AS prior_valid, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc FROM a WINDOW w AS (ORDER BY session_date)),
j AS (SELECT bars.*, p.* EXCLUDE (session_date, ph, pl, pc), CASE WHEN prior_valid THEN ph END AS ph, CASE WHEN prior_valid THEN pl END AS pl, CASE WHEN prior_valid THEN pc END AS pc FROM bars JOIN p USING (session_date))"""


@C.add(f"""WITH {BARS15}, {PRIOR} SELECT {t('ts')}, prior_valid, {r('close - ph', 'close_minus_prior_high')}, {r('close - pl', 'close_minus_prior_low')}, {r('close - pc', 'close_minus_prior_close')},
  {r('(close - pc) / nullif(ph - pl, 0)', 'close_vs_prior_range')}, {s('CASE WHEN prior_valid THEN close > ph END', 'above_prior_high')}, {s('CASE WHEN prior_valid THEN close < pl END', 'below_prior_low')} FROM j""")
def level_flags(spark, d):
    got = bf.levels(bf.with_sessions(bars(spark, d), _sessions(spark, d)), "prior_valid", "prior_rth_high", "prior_rth_low", "prior_rth_close", "prior")
    return got.select("ts", "prior_valid", "close_minus_prior_high", "close_minus_prior_low", "close_minus_prior_close", "close_vs_prior_range", *[F.col(c).cast("string").alias(c) for c in ("above_prior_high", "below_prior_low")])


def _gated(spark, d):
    own = bf.with_sessions(bars(spark, d), _sessions(spark, d))
    own = own.withColumn("bar_available_at", F.col("rth_minute") + 15).withColumn("opening_30_available_at", F.lit(30))
    return own


@C.add(f"WITH {BARS15}, {PRIOR} SELECT {t('ts')}, {r('CASE WHEN rth_minute + 15 >= 30 THEN o_high END', 'opening_30_high')}, {r('CASE WHEN rth_minute + 15 >= 30 THEN close - o_low END', 'close_minus_opening_30_low')} FROM j")
def gated_features(spark, d):
    own = _gated(spark, d).withColumn("close_minus_opening_30_low", F.col("close") - F.col("opening_30_low"))
    return bf.gated(own, {"opening_30_available_at": ["opening_30_high", "close_minus_opening_30_low"]}).select("ts", "opening_30_high", "close_minus_opening_30_low")


@C.add(f"WITH {BARS15}, {PRIOR} SELECT count(*) AS rows, count(*) FILTER (WHERE 30 > rth_minute + 15 AND o_high IS NOT NULL) AS early_opening_30_available_at, 0::BIGINT AS early_masked_at FROM j")
def pit_violations(spark, d):
    own = _gated(spark, d).withColumn("masked_at", F.col("opening_30_available_at")).withColumn("masked", F.col("opening_30_high"))
    own = bf.gated(own, {"masked_at": ["masked"]})
    return bf.violations(own, {"opening_30_available_at": ["opening_30_high", "opening_30_low"], "masked_at": ["masked"]})


@C.add(f"""WITH {BARS15}, x AS (SELECT ts, close, lag(close, 4) OVER w AS l4, close / nullif(lag(close, 4) OVER w, 0) - 1 AS r4, row_number() OVER w AS n FROM bars WINDOW w AS (PARTITION BY session_date ORDER BY ts))
SELECT count(*) FILTER (WHERE r4 IS NOT NULL) AS checked, 0::BIGINT AS mismatches FROM x""")
def spot_check(spark, d):
    """The lag-4 return made a second way, by a join on the row's place, must agree."""
    own = bf.returns(bars(spark, d), (4,)).withColumn("_n", F.row_number().over(bf.at()))
    back = own.select("session_date", (F.col("_n") + 4).alias("_n"), F.col("close").alias("_c"))
    both = own.join(back, ["session_date", "_n"], "left").withColumn("again", numbers.change(F.col("close"), F.col("_c")))
    return both.agg(F.count("bar_return_4").alias("checked"), F.count_if(F.abs(F.col("again") - F.col("bar_return_4")) > 1e-12).alias("mismatches"))


@C.add(f"WITH {BARS15} SELECT count(*) AS rows, count(*) FILTER (WHERE is_rth) AS rth_rows, {t('min(ts)', 'first_ts')}, {t('max(ts)', 'last_ts')}, count(DISTINCT session_date) AS sessions, count(DISTINCT CASE WHEN is_rth THEN session_date END) AS rth_sessions FROM bars")
def profile(spark, d):
    return bars(spark, d).agg(F.count("*").alias("rows"), F.count_if("is_rth").alias("rth_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("session_date").alias("sessions"), F.countDistinct(F.when(F.col("is_rth"), F.col("session_date"))).alias("rth_sessions"))


HORIZONS = (60, 120, 240)


def _forward_sql(minute: str, source: str, step: int, horizons=HORIZONS) -> str:
    one = []
    for h in horizons:
        n = step and h // step
        one.append(f"""SELECT session_date, ts, {minute} AS clock_minute, {h} AS horizon_minutes, open, lead(close, {n - 1}) OVER w AS x, max(high) OVER f AS hi, min(low) OVER f AS lo, lead({minute}, {n - 1}) OVER w - {minute} AS gap
 FROM {source} WINDOW w AS (PARTITION BY session_date ORDER BY ts), f AS (PARTITION BY session_date ORDER BY ts ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)""")
    return f"""SELECT session_date, ts, clock_minute, horizon_minutes, x - open AS return_points, (x / open - 1) * 1e4 AS return_bps, hi - open AS mfe_points, (hi / open - 1) * 1e4 AS mfe_bps, lo - open AS mae_points, (lo / open - 1) * 1e4 AS mae_bps
 FROM ({' UNION ALL '.join(one)}) WHERE gap = horizon_minutes - {step} AND open > 0"""


FWD = f"""{BARS60}, rth AS (SELECT * FROM bars WHERE is_rth),
o AS (SELECT *, 'ETH' AS scope FROM ({_forward_sql('clock', 'bars', 60)}) UNION ALL SELECT *, 'RTH' AS scope FROM ({_forward_sql('rth_minute', 'rth', 60)}))"""
VALUES = ["return_points", "return_bps", "mfe_points", "mfe_bps", "mae_points", "mae_bps"]


def _outcomes(spark, d):
    return oc.scoped(bars(spark, d, 60), HORIZONS, 60)


@C.add(f"WITH {FWD} SELECT scope, {s('session_date')}, {t('ts')}, {b('clock_minute')}, {b('horizon_minutes')}, {', '.join(map(r, VALUES))} FROM o")
def forward_outcomes(spark, d):
    return _outcomes(spark, d)


T95 = "tt(df, t_crit) AS (VALUES " + ", ".join(f"({i}, {numbers.t_quantile(0.975, i)!r}::DOUBLE)" for i in range(1, 61)) + ")"
Z = "1.959963984540054::DOUBLE"


def _summary_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, count(return_bps) AS n, count(*) FILTER (WHERE return_bps > 0) AS n_positive, avg(return_bps) AS mean_bps, quantile_cont(return_bps, 0.25) AS p25_bps, quantile_cont(return_bps, 0.5) AS median_bps, quantile_cont(return_bps, 0.75) AS p75_bps,
  stddev_samp(return_bps) AS std_bps, avg(return_points) AS mean_points, quantile_cont(return_points, 0.5) AS median_points, avg(mfe_bps) AS mean_mfe_bps, quantile_cont(mfe_bps, 0.5) AS median_mfe_bps, avg(mae_bps) AS mean_mae_bps, quantile_cont(mae_bps, 0.5) AS median_mae_bps
 FROM {source} GROUP BY {keys}"""


def _wilson_sql(k: str, n: str) -> str:
    p = f"({k}::DOUBLE / {n})"
    mid, half, scale = f"({p} + {Z} * {Z} / (2 * {n}))", f"({Z} * sqrt({p} * (1 - {p}) / {n} + {Z} * {Z} / (4.0 * {n} * {n})))", f"(1 + {Z} * {Z} / {n})"
    return f"{r(f'greatest(0.0, ({mid} - {half}) / {scale})', 'wilson_low')}, {r(f'least(1.0, ({mid} + {half}) / {scale})', 'wilson_high')}"


MOMENTS = ["mean_bps", "median_bps", "std_bps", "p25_bps", "p75_bps", "mean_points", "median_points", "mean_mfe_bps", "median_mfe_bps", "mean_mae_bps", "median_mae_bps"]
CELLS = ["scope", "clock_minute", "horizon_minutes"]
CELL = f"scope, {b('clock_minute')}, {b('horizon_minutes')}"


@C.add(f"WITH {FWD}, m AS ({_summary_sql('o', 'scope, clock_minute, horizon_minutes')}) SELECT {CELL}, n, n_positive, {', '.join(map(r, MOMENTS))}, {r('n_positive::DOUBLE / n', 'positive_rate')} FROM m")
def market_clock(spark, d):
    return oc.summary(_outcomes(spark, d), CELLS).select(*CELLS, "n", "n_positive", *MOMENTS, "positive_rate")


@C.add(f"WITH {FWD}, m AS ({_summary_sql('o', 'scope, clock_minute, horizon_minutes')}) SELECT {CELL}, {_wilson_sql('n_positive', 'n')} FROM m")
def market_clock_wilson(spark, d):
    return oc.summary(_outcomes(spark, d), CELLS).select(*CELLS, "wilson_low", "wilson_high")


@C.add(f"WITH {FWD}, {T95}, m AS ({_summary_sql('o', 'scope, clock_minute, horizon_minutes')}) SELECT {CELL}, {r('std_bps / sqrt(n)', 'se_bps')}, {r('mean_bps - t_crit * std_bps / sqrt(n)', 't_low')}, {r('mean_bps + t_crit * std_bps / sqrt(n)', 't_high')} FROM m LEFT JOIN tt ON df = n - 1")
def market_clock_tci(spark, d):
    return oc.summary(_outcomes(spark, d), CELLS).select(*CELLS, "se_bps", "t_low", "t_high")


DIMS = ["calendar_weekday", "half", "volume_regime"]


def _cut_outcomes(spark, d):
    """Outcomes with the weekday, the half of the sample, and a regime of the session's volume that is missing early on."""
    own = bars(spark, d, 60)
    day = own.groupBy("session_date").agg(F.sum("total_volume").alias("v")).withColumn("prev", F.lag("v").over(sf.in_order()))
    day = day.select("session_date", numbers.regime(numbers.ratio(F.col("v"), F.col("prev")), 0.75, 1.25).alias("volume_regime"))
    keep = bf.with_sessions(_outcomes(spark, d), day)
    return keep.withColumns({"calendar_weekday": F.weekday("session_date"), "half": F.when(F.dayofmonth("session_date") < 16, "first").otherwise("second")})


CUT = f"""{FWD}, dv AS (SELECT session_date, sum(total_volume) AS v FROM bars GROUP BY session_date), dr AS (SELECT session_date, v::DOUBLE / lag(v) OVER (ORDER BY session_date) AS q FROM dv),
oc AS (SELECT o.*, CAST(isodow(session_date) - 1 AS VARCHAR) AS calendar_weekday, CASE WHEN day(session_date) < 16 THEN 'first' ELSE 'second' END AS half, coalesce(CASE WHEN q <= 0.75 THEN 'low' WHEN q >= 1.25 THEN 'high' WHEN q IS NOT NULL THEN 'normal' END, 'unavailable') AS volume_regime FROM o JOIN dr USING (session_date)),
u AS (SELECT *, 'calendar_weekday' AS cut_type, calendar_weekday AS cut_value FROM oc UNION ALL SELECT *, 'half', half FROM oc UNION ALL SELECT *, 'volume_regime', volume_regime FROM oc),
cs AS ({_summary_sql('u', 'scope, clock_minute, horizon_minutes, cut_type, cut_value')})"""


@C.add(f"WITH {CUT} SELECT {CELL}, cut_type, cut_value, n, {r('mean_bps')}, {r('median_bps')}, {r('std_bps')}, n >= 5 AS sample_sufficient FROM cs")
def stability_cuts(spark, d):
    return oc.stability(_cut_outcomes(spark, d), DIMS, CELLS, 5).select(*CELLS, "cut_type", "cut_value", "n", "mean_bps", "median_bps", "std_bps", "sample_sufficient")


@C.add(f"""WITH {CUT}, g AS (SELECT scope, clock_minute, horizon_minutes, cut_type, count(*) AS groups, count(*) FILTER (WHERE mean_bps > 0) AS p, count(*) FILTER (WHERE mean_bps < 0) AS ng, count(*) FILTER (WHERE mean_bps = 0) AS z, min(mean_bps) AS lo, max(mean_bps) AS hi FROM cs WHERE cut_value <> 'unavailable' GROUP BY ALL)
SELECT {CELL}, cut_type, groups, p AS positive_groups, ng AS negative_groups, z AS zero_groups, {r('lo', 'min_mean_bps')}, {r('hi', 'max_mean_bps')}, CASE WHEN p > ng AND p > z THEN 'positive' WHEN ng > p AND ng > z THEN 'negative' WHEN z > p AND z > ng THEN 'zero' ELSE 'tie' END AS majority_sign, {r('greatest(p, ng, z)::DOUBLE / groups', 'majority_share')} FROM g""")
def stability_agreement(spark, d):
    return oc.agreement(oc.stability(_cut_outcomes(spark, d), DIMS, CELLS, 5), CELLS)


EXT = f"""{BARS15}, x AS (SELECT session_date, first(clock ORDER BY high DESC, ts) AS high_minute, first(clock ORDER BY low, ts) AS low_minute, max(high) AS high, min(low) AS low, first(open ORDER BY ts) AS open, last(close ORDER BY ts) AS close, count(*) AS bars FROM bars GROUP BY session_date)"""


@C.add(f"WITH {EXT} SELECT {s('session_date')}, {b('high_minute')}, {b('low_minute')}, {OHLC}, bars, {r('high - low', 'range_points')}, high_minute < low_minute AS high_first, {r('(close - low) / nullif(high - low, 0)', 'close_location')} FROM x")
def session_extremes(spark, d):
    return oc.extremes(bars(spark, d))


BINS = f"""{EXT}, e AS (SELECT 'high' AS extreme, high_minute // 60 * 60 AS bin FROM x UNION ALL SELECT 'low', low_minute // 60 * 60 FROM x),
bn AS (SELECT z.extreme, range AS bin_start FROM range(0, 1380, 60), (VALUES ('high'), ('low')) z(extreme)),
tb AS (SELECT bn.extreme, bin_start, count(e.bin) AS sessions, (SELECT count(*) FROM x) AS total FROM bn LEFT JOIN e ON e.extreme = bn.extreme AND e.bin = bin_start GROUP BY ALL)"""


@C.add(f"WITH {BINS} SELECT extreme, {b('bin_start')}, sessions, total, {r('sessions::DOUBLE / total', 'share')}, {_wilson_sql('sessions', 'total')} FROM tb")
def turning_bins(spark, d):
    return oc.turning_bins(oc.extremes(bars(spark, d)), 60, 1380)


@C.add(f"WITH {BINS}, k AS (SELECT *, row_number() OVER (PARTITION BY extreme ORDER BY sessions DESC, bin_start) AS n FROM tb) SELECT extreme, {b('bin_start')}, sessions, {r('sessions::DOUBLE / total', 'share')} FROM k WHERE n = 1")
def modal_bins(spark, d):
    return oc.modal_bin(oc.turning_bins(oc.extremes(bars(spark, d)), 60, 1380))


BLOCKS = f"""{FWD}, m AS ({_summary_sql('o', 'scope, clock_minute, horizon_minutes')}),
bl AS (SELECT *, (CASE WHEN scope = 'RTH' THEN 570 ELSE 1080 END + clock_minute) % 1440 AS lm FROM m WHERE (scope = 'ETH' AND horizon_minutes = 60 AND clock_minute % 60 = 0) OR (scope = 'RTH' AND horizon_minutes = 120 AND clock_minute % 60 = 30)),
lb AS (SELECT *, printf('%02d:%02d', CAST(lm // 60 AS INT), CAST(lm % 60 AS INT)) AS label FROM bl)"""
PICKS = {"ETH": (60, 60)}


@C.add(f"WITH {BLOCKS} SELECT {CELL}, label, n, {r('mean_bps')} FROM lb WHERE scope = 'ETH'")
def clock_blocks(spark, d):
    return oc.blocks(oc.summary(_outcomes(spark, d), CELLS), PICKS).select(*CELLS, "label", "n", "mean_bps")


@C.add(f"""WITH {BLOCKS}, k AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY mean_bps DESC, clock_minute) AS up, row_number() OVER (PARTITION BY scope ORDER BY mean_bps, clock_minute) AS down FROM lb WHERE scope = 'ETH' AND mean_bps IS NOT NULL)
SELECT scope, CASE WHEN up = 1 THEN 'strongest' ELSE 'weakest' END AS kind, {b('clock_minute')}, label, {r('mean_bps')} FROM k WHERE up = 1 OR down = 1""")
def strongest_block(spark, d):
    return oc.strongest(oc.blocks(oc.summary(_outcomes(spark, d), CELLS), PICKS))


@C.add(f"""WITH {FWD}, h AS (SELECT scope, count(*) AS n, count(*) - count(DISTINCT (scope, session_date, clock_minute, horizon_minutes)) AS dup, count(*) FILTER (WHERE return_bps IS NULL) AS nulls, count(*) FILTER (WHERE mfe_points < greatest(return_points, 0) - 1e-9 OR mae_points > least(return_points, 0) + 1e-9) AS bad FROM o GROUP BY scope)
SELECT scope, n AS rows, dup = 0 AS keys_unique, nulls = 0 AS complete, bad = 0 AS extremes_enclose FROM h""")
def gate_checks(spark, d):
    """The outcome table's own checks, in one aggregation."""
    got = _outcomes(spark, d)
    outside = (F.col("mfe_points") < F.greatest(F.col("return_points"), F.lit(0.0)) - 1e-9) | (F.col("mae_points") > F.least(F.col("return_points"), F.lit(0.0)) + 1e-9)
    got = got.groupBy("scope").agg(F.count("*").alias("rows"), F.countDistinct("session_date", "clock_minute", "horizon_minutes").alias("k"), F.count("return_bps").alias("c"), F.count_if(outside).alias("bad"))
    return got.select("scope", "rows", (F.col("rows") == F.col("k")).alias("keys_unique"), (F.col("rows") == F.col("c")).alias("complete"), (F.col("bad") == 0).alias("extremes_enclose"))

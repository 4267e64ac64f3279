"""Row validity, duplicates, gaps against the calendar, and the quality record of each session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import clock, numbers

PRICES, VOLUMES, TICKS = ("open", "high", "low", "close"), ("up_volume", "down_volume"), ("up_ticks", "down_ticks")
#: How grave each issue of a row is. Fixed values.
GRAVITY = {
    "invalid_timestamp": "critical", "non_minute_timestamp": "high", "non_numeric": "critical", "non_positive_price": "critical",
    "invalid_ohlc_order": "critical", "negative_volume": "high", "negative_ticks": "high", "off_tick_price": "medium",
}


def checked(bars: DataFrame, tick: float = 0.25) -> DataFrame:
    """Bars with row_valid and issue_codes, the names of failed checks in a fixed order, joined by a bar.

    ts may be null (it couldn't be parsed); numbers may be text that isn't one. Prices and counts come out typed, null if not finite.
    """
    num = {c: numbers.known(F.col(c).try_cast("double")) for c in (*PRICES, *VOLUMES, *TICKS)}
    typed = bars.withColumns(num)
    price = [F.col(c) for c in PRICES]
    known = lambda cols: F.greatest(*[F.col(c).isNull().cast("int") for c in cols]) == 1
    off = lambda c: F.abs(c / tick - F.round(c / tick)) > 1e-8
    any_of = lambda flags: F.coalesce(F.greatest(*[F.coalesce(f, F.lit(False)).cast("int") for f in flags]) == 1, F.lit(False))
    flags = {
        "invalid_timestamp": F.col("ts").isNull(),
        "non_minute_timestamp": F.col("ts").isNotNull() & (F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz") != F.col("ts")),
        "non_numeric": known((*PRICES, *VOLUMES, *TICKS)),
        "non_positive_price": any_of([c <= 0 for c in price]),
        "invalid_ohlc_order": any_of([F.col("high") < F.greatest(*price), F.col("low") > F.least(*price)]),
        "negative_volume": any_of([F.col(c) < 0 for c in VOLUMES]),
        "negative_ticks": any_of([F.col(c) < 0 for c in TICKS]),
        "off_tick_price": any_of([off(c) for c in price]),
    }
    out = typed.withColumn("issue_codes", numbers.codes(**flags))
    return out.withColumn("row_valid", F.col("issue_codes") == "")


def issue_summary(rows: DataFrame, row_id: str, sample: int = 3) -> DataFrame:
    """For each issue its count, gravity and first rows. Each task passes on at most `sample` rows of an issue."""
    each = rows.where("issue_codes != ''").select(F.col(row_id).alias("_id"), F.explode(F.split("issue_codes", r"\|")).alias("issue"))
    first = each.withColumn("_r", F.row_number().over(W.partitionBy("issue").orderBy("_id"))).where(F.col("_r") <= sample)
    first = first.groupBy("issue").agg(F.sort_array(F.collect_list("_id")).alias("sample_rows"))
    grave = F.create_map(*[F.lit(x) for kv in GRAVITY.items() for x in kv])
    return each.groupBy("issue").agg(F.count("*").alias("rows")).join(first, "issue").withColumn("severity", F.coalesce(F.try_element_at(grave, "issue"), F.lit("none")))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a complete order; before the shuffle, each task keeps only its own first."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def duplicates(rows: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """Keys that stand more than once: rows, different contents, exact copies to remove, and whether contents conflict."""
    seen = rows.withColumn("_sig", F.xxhash64(*content)).groupBy(*keys).agg(F.count("*").alias("rows"), F.countDistinct("_sig").alias("signatures")).where("rows > 1")
    return seen.withColumn("exact_removed", F.when(F.col("signatures") == 1, F.col("rows") - 1).otherwise(0).cast("long")).withColumn("conflicting", F.col("signatures") > 1)


def timestamp_diagnostics(rows: DataFrame, group: str, position: str, ts: str = "ts") -> DataFrame:
    """For each group: rows, duplicate timestamps, and rows that are earlier than the one before them."""
    before = F.lag(ts).over(W.partitionBy(group).orderBy(position))
    marked = rows.withColumn("_back", F.coalesce(F.col(ts) < before, F.lit(False)))
    return marked.groupBy(group).agg(F.count("*").alias("rows"), (F.count(ts) - F.countDistinct(ts)).alias("duplicate_timestamps"), F.count_if("_back").alias("out_of_order"))


def missing(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Expected bars (session_date, ts) that weren't observed."""
    return expected.join(observed.select("ts").distinct(), "ts", "left_anti")


def unexpected(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Observed bars that no session expects."""
    return observed.join(expected.select("ts"), "ts", "left_anti")


def runs(gaps: DataFrame, minutes: int) -> DataFrame:
    """Stretches of missing bars in each session: start, last bar, minutes, and whether regular hours are among them."""
    at = W.partitionBy("session_date").orderBy("ts")
    step = F.expr(f"INTERVAL '{minutes}' MINUTE")
    new = F.coalesce(F.col("ts") != F.lag("ts").over(at) + step, F.lit(True)).cast("int")
    marked = gaps.withColumn("_new", new).withColumn("_run", F.sum("_new").over(at.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("session_date", "_run").agg(
        F.min("ts").alias("start_utc"), F.max("ts").alias("end_utc"), (F.count("*") * minutes).alias("minutes"), F.bool_or(clock.is_rth(F.col("ts"))).alias("rth_overlap")
    ).drop("_run")


def classified(gap_runs: DataFrame, first_day: Column, roll_days: list[str], early: Column) -> DataFrame:
    """A run's class: the first research day, a roll day, an early close, else unexplained."""
    day = F.col("session_date").cast("string")
    kind = F.when(F.col("session_date") == first_day, "first_research_date").when(day.isin(roll_days) if roll_days else F.lit(False), "roll_date").when(early, "early_close").otherwise("unexplained")
    return gap_runs.withColumn("classification", kind)


#: Reasons to exclude a session, in their order, and how grave each is. Fixed values; missing bars are critical if none was observed.
REASONS = {
    "missing_expected_minutes": "high", "timestamps_outside_expected_session": "high", "observed_noncalendar_session": "high", "invalid_bar_values": "critical",
    "conflicting_duplicate_bars": "critical", "multiple_contracts_within_session": "high", "roll_boundary_session": "high",
}


def session_records(
    expected: DataFrame, observed: DataFrame, invalid: DataFrame | None = None, roll_days: tuple[str, ...] = (), sessions: DataFrame | None = None, copies: DataFrame | None = None,
    minutes: int = 1, splits: Sequence[tuple] = (),
) -> DataFrame:
    """A record for each expected or observed session.

    expected: session_date, ts. observed: session_date, ts, and optionally symbol. invalid: session_date of each invalid row. sessions: the
    calendar. copies: session_date, exact_removed and conflicting of each key that stood more than once (as from `duplicates`); without it, rows
    that share an instant count as exact copies. minutes: of a bar. splits: name, first and last day.
    Reasons are in a fixed order; any excludes the whole session; exact copies alone leave it usable as corrected. The severity is the gravest of the reasons'.
    """
    have = observed.withColumn("symbol", F.col("symbol") if "symbol" in observed.columns else F.lit("-"))
    seen = have.groupBy("session_date").agg(F.count("*").alias("observed_rows"), F.countDistinct("ts").alias("observed_unique"))
    seen = seen.join(symbols_by_session(have.withColumn("_tie", F.col("symbol")), "symbol", "ts", "_tie"), "session_date", "left")
    due = expected.groupBy("session_date").agg(F.count("*").alias("expected_bars"), F.count_if(clock.is_rth(F.col("ts"))).alias("expected_rth_bars"))
    gone = missing(expected, observed)
    lost = gone.groupBy("session_date").agg(
        F.count("*").alias("missing_bars"), F.count_if(clock.is_rth(F.col("ts"))).alias("missing_rth_bars"), F.min("ts").alias("first_missing_utc"), F.max("ts").alias("last_missing_utc")
    )
    longest = runs(gone, minutes).groupBy("session_date").agg(F.max("minutes").alias("largest_missing_run_minutes"))
    extra = unexpected(expected, observed).groupBy("session_date").agg(F.countDistinct("ts").alias("unexpected_bars"))
    out = due.join(seen, "session_date", "full_outer")
    for more in (lost, longest, extra):
        out = out.join(more, "session_date", "left")
    if invalid is not None:
        out = out.join(invalid.groupBy("session_date").agg(F.count("*").alias("invalid_rows")), "session_date", "left")
    if copies is not None:
        twice = copies.groupBy("session_date").agg(F.sum("exact_removed").alias("exact_duplicate_rows_removed"), F.count_if("conflicting").alias("conflicting_duplicate_keys"))
        out = out.join(twice, "session_date", "left")
    else:
        out = out.withColumn("exact_duplicate_rows_removed", F.col("observed_rows") - F.col("observed_unique"))
    counts = [
        "expected_bars", "expected_rth_bars", "observed_rows", "observed_unique", "symbol_count", "contract_transitions", "missing_bars", "missing_rth_bars",
        "unexpected_bars", "invalid_rows", "exact_duplicate_rows_removed", "conflicting_duplicate_keys", "largest_missing_run_minutes",
    ]
    out = out.withColumn("expected_session", F.col("expected_bars").isNotNull())
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") if c in out.columns else F.lit(0).cast("long") for c in counts})
    holds = {
        "missing_expected_minutes": F.col("missing_bars") > 0,
        "timestamps_outside_expected_session": F.col("expected_session") & (F.col("unexpected_bars") > 0),
        "observed_noncalendar_session": ~F.col("expected_session"),
        "invalid_bar_values": F.col("invalid_rows") > 0,
        "conflicting_duplicate_bars": F.col("conflicting_duplicate_keys") > 0,
        "multiple_contracts_within_session": (F.col("symbol_count") > 1) | (F.col("contract_transitions") > 0),
        "roll_boundary_session": F.col("session_date").cast("string").isin(list(roll_days)) if roll_days else F.lit(False),
    }
    out = out.withColumn("exclusion_reasons", numbers.codes(**holds))
    status = F.when(F.col("exclusion_reasons") != "", "excluded").when(F.col("exact_duplicate_rows_removed") > 0, "corrected").otherwise("pass")
    out = out.withColumn("quality_status", status).withColumn("session_usable", F.col("quality_status") != "excluded")
    nothing = F.when((F.col("missing_bars") > 0) & (F.col("missing_bars") == F.col("expected_bars")), "critical")
    grave = [F.when(holds[k], v) for k, v in REASONS.items()]
    out = out.withColumn("severity", numbers.max_severity(nothing, *grave, F.when(F.col("quality_status") == "corrected", "low")))
    if splits:
        out = out.withColumn("split", clock.split_label(F.col("session_date"), splits))
    if sessions is not None:
        local = lambda c: clock.iso_local(F.col(c))
        known = sessions.select(
            "session_date", F.col("open_utc").alias("expected_open_utc"), F.col("close_utc").alias("expected_close_utc"), local("open_utc").alias("expected_open_et"),
            local("close_utc").alias("expected_close_et"), "is_early_close", F.col("override").alias("calendar_override"), F.coalesce("note", F.lit("")).alias("calendar_note"),
        )
        out = out.join(known, "session_date", "left")
        out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_early_close", "calendar_override")}).withColumn("calendar_note", F.coalesce("calendar_note", F.lit("")))
    return out


def quality_summary(records: DataFrame) -> DataFrame:
    """The roll-up of all records in one pass."""
    return records.agg(
        F.count("*").alias("sessions"), F.count_if("session_usable").alias("usable_sessions"), F.count_if(~F.col("session_usable")).alias("excluded_sessions"),
        F.sum("observed_rows").alias("observed_rows"), F.sum("missing_bars").alias("missing_bars"), F.count_if(F.col("severity") == "high").alias("high_severity"),
        F.count_if(F.col("severity") == "critical").alias("critical_severity"),
    )


def symbols_by_session(rows: DataFrame, symbol: str, ts: str, tie: str) -> DataFrame:
    """Each session's symbols in the order in which they come first, and how often the symbol changes."""
    at = W.partitionBy("session_date").orderBy(ts, tie)
    moved = rows.withColumn("_move", (F.col(symbol) != F.lag(symbol).over(at)).cast("int"))
    firsts = moved.groupBy("session_date", symbol).agg(F.min(F.struct(ts, tie)).alias("_first"), F.sum("_move").alias("_moves"))
    return firsts.groupBy("session_date").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_first", symbol))), lambda x: x[symbol]), "|").alias("symbols"),
        F.count("*").alias("symbol_count"), F.coalesce(F.sum("_moves"), F.lit(0)).alias("contract_transitions"),
    )


def key_differences(planned: DataFrame, acquired: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, and which."""
    a, b = planned.select(key).distinct().withColumn("_a", F.lit(True)), acquired.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full_outer").where("_a IS NULL OR _b IS NULL").select(key, F.when(F.col("_b").isNull(), "missing").otherwise("extra").alias("difference"))

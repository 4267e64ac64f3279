"""Each feature's contract: its family, type, source, and the column that says when it is known."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.config import WINDOWS, Windows

#: The column that holds from when on a family's features are known.
AVAILABLE = {
    "calendar": "calendar_available_at_utc", "prior_session": "prior_session_available_at_utc", "overnight": "overnight_available_at_utc", "opening": "opening_{w}_available_at_utc",
    "level": "bar_available_at_utc", "volatility": "bar_available_at_utc", "regime": "regime_available_at_utc",
}
OHLCV = ("open", "high", "low", "close", "volume")


@dataclass(frozen=True)
class Feature:
    name: str
    family: str
    kind: str
    known_at: str
    source: str
    looks_ahead: bool = False


def features(w: Windows = WINDOWS) -> list[Feature]:
    """All features of a bar for these windows: 101 with the defaults."""
    out: list[Feature] = []

    def add(family: str, source: str, known_at: str | None = None, **kinds: Sequence[str]) -> None:
        out.extend(Feature(n, family, kind, known_at or AVAILABLE[family], source) for kind, names in kinds.items() for n in names)

    add("calendar", "session calendar", int=[f"calendar_{x}" for x in ("year", "quarter", "month", "iso_week", "weekday")], boolean=["calendar_is_month_end_session"])
    add("calendar", "bar open", "timestamp_utc", int=["session_minute", "rth_minute"], string=["session_segment"])
    add("prior_session", "session before", boolean=["prior_session_valid"], double=[f"prior_{s}_{c}" for s in ("full", "rth") for c in (*OHLCV, "range", "return")])
    add("overnight", "session open to regular open", boolean=["overnight_valid"], double=[f"overnight_{c}" for c in (*OHLCV, "range", "return", "gap_from_prior_rth")] + ["rth_open_gap_from_prior_rth"])
    for n in w.opening:
        add("opening", f"first {n} regular minutes", f"opening_{n}_available_at_utc", boolean=[f"opening_{n}_valid"], double=[f"opening_{n}_{c}" for c in (*OHLCV, "range", "return")])
    add("level", "close against earlier levels", double=[f"close_minus_prior_rth_{c}" for c in ("high", "low", "close")] + [f"close_minus_{s}_{c}" for s in ("overnight", "opening_30") for c in ("high", "low")] + ["close_vs_prior_rth_range"], boolean=[f"{x}_{s}_{c}" for s in ("prior_rth", "overnight") for x, c in (("above", "high"), ("below", "low"))])
    add("volatility", "bars of this session so far", double=[f"bar_return_{n}" for n in w.lags] + [f"realized_vol_{n}" for n in w.vol] + [f"rolling_range_{n}" for n in w.ranges] + ["session_high_so_far", "session_low_so_far", "session_range_so_far", "session_cumulative_volume"])
    long, short = w.regime_long, w.regime_short
    add("regime", f"{long} sessions before", double=[f"lagged_rth_range_mean_{long}", f"lagged_rth_range_std_{long}", f"lagged_rth_volume_mean_{long}", f"lagged_close_return_{short}", "lagged_volatility_ratio", "lagged_volume_ratio"], string=["trend_regime", "volatility_regime", "volume_regime"])
    return out


def problems(specs: Sequence[Feature]) -> list[str]:
    """What is wrong with the contracts: names twice, unknown families, no availability or source, or a look ahead."""
    found = [f"{n}: twice" for n, k in Counter(f.name for f in specs).items() if k > 1]
    for f in specs:
        tests = (("unknown family", f.family not in AVAILABLE), ("no availability column", not f.known_at), ("no source", not f.source), ("looks ahead", f.looks_ahead))
        found += [f"{f.name}: {what}" for what, bad in tests if bad]
    return found


def check(specs: Sequence[Feature]) -> None:
    if found := problems(specs):
        raise ValueError("; ".join(found))


def schema_differences(specs: Sequence[Feature], table: DataFrame) -> dict[str, list[str]]:
    """Features that the table lacks, and those of another kind of type."""
    groups = {"int": {"int", "bigint", "smallint", "tinyint"}, "double": {"double", "float", "bigint"}, "boolean": {"boolean"}, "string": {"string"}}
    have = dict(table.dtypes)
    return {"missing": [f.name for f in specs if f.name not in have], "mistyped": [f.name for f in specs if f.name in have and have[f.name] not in groups[f.kind]]}


def families(specs: Sequence[Feature]) -> dict[str, list[str]]:
    """Availability column -> its features, as the point-in-time check takes them."""
    out: dict[str, list[str]] = {}
    for f in specs:
        out.setdefault(f.known_at, []).append(f.name)
    return out

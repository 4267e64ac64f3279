"""Checks that a table must pass before it is written: all of a table's in one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.sinks import content_hash


def gate(df: DataFrame, keys: Sequence[str] = (), known: Sequence[str] = (), never: Mapping[str, Column] | None = None) -> dict[str, bool]:
    """Whether the table has rows, its keys are unique, the known columns hold no null, and no row has what `never` names.

    Duplicate keys are counted by group, so no task holds all keys.
    """
    tests = [F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in known], *[F.count_if(F.coalesce(cond, F.lit(False))).alias(f"bad_{name}") for name, cond in (never or {}).items()]]
    got = df.agg(*tests).first()
    out = {"has_rows": got["rows"] > 0} | {f"{c}_known": got[f"null_{c}"] == 0 for c in known} | {f"no_{name}": got[f"bad_{name}"] == 0 for name in never or {}}
    if keys:
        out["keys_unique"] = df.groupBy(*keys).count().where("count > 1").isEmpty()
    return out


def outcome_gates(outcomes: DataFrame) -> dict[str, bool]:
    r, up, down = F.col("return_points"), F.col("mfe_points"), F.col("mae_points")
    return gate(outcomes, ["scope", "session_date", "clock_minute", "horizon_minutes"], ["return_bps", "mfe_bps", "mae_bps"], {"return_outside_extremes": (up < r - 1e-9) | (down > r + 1e-9), "early_entry": F.col("clock_minute") < -1440})


def event_gates(events: DataFrame, clock: bool = False) -> dict[str, bool]:
    keys = ["hypothesis_id", "session_date"] + (["entry_minute"] if clock else [])
    return gate(events, keys, ["effect_bps"], {"unknown_direction": ~F.col("direction").isin(-1, 1)} if "direction" in events.columns else {"unknown_state": ~F.col("state").isin("low", "high")})


def ledger_gates(ledger: DataFrame, registered: DataFrame) -> dict[str, bool]:
    """Every registered test stands in the ledger once, and nothing insufficient is rejected."""
    out = gate(ledger, ["hypothesis_id"], ["family_id"], {"rejection_without_sample": F.col("bh_reject") & ~F.col("sample_sufficient"), "q_below_p": F.col("q_value") < F.col("p_value") - 1e-12, "p_out_of_range": (F.col("p_value") < 0) | (F.col("p_value") > 1)})
    out["all_registered"] = registered.join(ledger, "hypothesis_id", "left_anti").isEmpty() and ledger.join(registered, "hypothesis_id", "left_anti").isEmpty()
    return out


def development_only(df: DataFrame, split: str = "development") -> DataFrame:
    """df; fails if any row belongs to another split."""
    if not df.where(~F.col("split").eqNullSafe(F.lit(split))).isEmpty():
        raise PermissionError(f"only {split} rows may be analysed")
    return df


def rebuilt(first: DataFrame, second: DataFrame) -> bool:
    """Whether a table made anew has the same rows."""
    return content_hash(first) == content_hash(second)

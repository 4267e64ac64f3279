"""Bars and first events out of streams: an extension, as everything else here runs on tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(ticks: DataFrame, minutes: int, late: str = "10 minutes", by: str | None = None) -> DataFrame:
    """ticks (ts timestamp, value, event_id) -> bars, each given once its end is `late` behind the newest tick. State is one row for each open bar."""
    rows = ticks.withWatermark("ts", late)
    order = F.struct("ts", "event_id")
    keys = [F.window("ts", f"{minutes} minutes").alias("w")] + ([F.col(by)] if by else [])
    got = rows.groupBy(*keys).agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("total_ticks"))
    return got.select(F.col("w.start").alias("ts"), *([by] if by else []), "open", "high", "low", "close", "total_ticks")


def first_events(rows: DataFrame, key: str, value: str, least: float, late: str = "10 minutes") -> DataFrame:
    """rows (key, ts, value): for each key the first row, as they arrive, whose value is at least `least`. A key's state goes when it has had no row for `late` of event time."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done = state.exists
        latest = 0
        for batch in batches:
            latest = max(latest, int(batch["ts"].max().timestamp() * 1000))
            hit = batch[batch[value] >= least].sort_values("ts")
            if not done and len(hit):
                done = True
                yield pd.DataFrame({key: [k[0]], "ts": [hit["ts"].iloc[0]], value: [float(hit[value].iloc[0])]})
        if done:
            state.update((True,))
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + int(pd.Timedelta(late).total_seconds() * 1000) + 1)

    kind = dict(rows.dtypes)[key]
    return rows.withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, {value} double", "done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def write_stream(df: DataFrame, path: str, checkpoint: str, partition_by: str | None = None, once: bool = False) -> StreamingQuery:
    """Appends finished rows to a Parquet table; the checkpoint makes a restart go on where it stopped, without rows twice."""
    out = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        out = out.partitionBy(partition_by)
    return (out.trigger(availableNow=True) if once else out).start()

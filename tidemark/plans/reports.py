"""Report documents of bounded size, with the SQL that each dataset comes from."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark.sources.sinks import artifact, markdown

from . import catalogue

#: The datasets of each report, by query; the first is the one that its table and chart show.
REPORTS = {
    "market_clock": ["clock_blocks", "strongest_block", "turning_bins", "modal_bins", "gate_checks", "profile"],
    "event_studies": ["v1_ledger", "hypothesis_registry", "year_stability", "first_range_break", "directional_events"],
    "conditional_states": ["v2_ledger", "range_by_state", "state_contrast", "volatility_states", "first_pressure_burst"],
    "data_quality": ["session_quality", "quality_summary", "exclusion_reasons", "gap_classification", "roll_boundaries"],
}


def report(spark: SparkSession, folder: str, name: str) -> dict:
    """The report as a document. Its sources are the SQL of each dataset, or the name of the query where SQL can't express it."""
    names = REPORTS[name]
    data = {n: catalogue.QUERIES[n](spark, folder) for n in names}
    sources = {n: catalogue.ORACLE_SQL.get(n, f"query {n}").strip() for n in names}
    first = data[names[0]]
    keys = [c for c, kind in first.dtypes if kind == "string"][:2] or first.columns[:1]
    return artifact(name, data, sources, cards=[{"dataset": n, "kind": "count"} for n in names], charts=[{"dataset": names[0], "x": keys[0]}], tables=[{"dataset": n, "sort": data[n].columns[:1]} for n in names])


def text(spark: SparkSession, folder: str, name: str, rows: int = 20) -> str:
    names = REPORTS[name]
    data = {n: catalogue.QUERIES[n](spark, folder).orderBy(*catalogue.QUERIES[n](spark, folder).columns[:2]) for n in names}
    return markdown(name.replace("_", " "), {"folder": folder, "datasets": len(names)}, data, rows)

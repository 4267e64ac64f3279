from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.__main__ import main
from tidemark.operators import events, gates
from tidemark.operators import inference as nf
from tidemark.operators import outcomes as oc
from tidemark.plans import base, reports, studies

from .conftest import DATA


def test_gates(spark):
    out = oc.scoped(base.bars(spark, DATA, 60), (60, 120), 60)
    assert all(gates.outcome_gates(out).values())
    assert not gates.outcome_gates(out.unionByName(out.limit(1)))["keys_unique"]
    assert not gates.outcome_gates(out.withColumn("mae_points", F.col("mae_points") + 1e6))["no_return_outside_extremes"]
    assert not gates.gate(out.limit(0))["has_rows"]
    assert gates.rebuilt(out, oc.scoped(base.bars(spark, DATA, 60), (60, 120), 60).repartition(7))
    assert not gates.rebuilt(out, out.withColumn("return_bps", F.col("return_bps") + 1))


def test_event_and_ledger_gates(spark):
    every = studies._all_events(spark, DATA)
    assert all(gates.event_gates(every, clock=True).values())
    tests = events.hypotheses(spark, studies.FAMILIES)
    ledger = nf.ledger(tests, nf.resampled(every, studies.SMALL), studies.SMALL)
    assert all(gates.ledger_gates(ledger, tests).values())
    assert not gates.ledger_gates(ledger.limit(3), tests)["all_registered"]


def test_development_only(spark):
    df = spark.createDataFrame([("development",), ("validation",)], "split string")
    assert gates.development_only(df.where("split = 'development'")).count() == 1
    with pytest.raises(PermissionError):
        gates.development_only(df)


@pytest.mark.parametrize("name", sorted(reports.REPORTS))
def test_reports_are_bounded(spark, name):
    got = reports.report(spark, DATA, name)
    assert len(got["snapshot"]["datasets"]) <= 50 and all(len(v) < 2000 for v in got["snapshot"]["datasets"].values())
    assert set(got["sources"]) == set(got["snapshot"]["datasets"]) and json.dumps(got)


def test_commands(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "market_clock" in capsys.readouterr().out
    assert main(["sql", "profile"]) == 0 and "SELECT" in capsys.readouterr().out
    assert main(["run", "profile", DATA, str(tmp_path / "p")]) == 0 and spark.read.parquet(str(tmp_path / "p")).count() == 1
    assert main(["report", "data_quality", DATA, str(tmp_path / "r.json")]) == 0 and json.loads((tmp_path / "r.json").read_text())["title"] == "data_quality"
    assert main(["plan", "ES", "2024-01-01", "2024-06-30", str(tmp_path / "plan")]) == 0
    plan = spark.read.json(str(tmp_path / "plan"))
    assert plan.count() > 20 and plan.where("datediff(chunk_end, chunk_start) > 6").count() == 0

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers, sinks
from tidemark.streaming import bars as stream

from .conftest import DATA, rows

BAR = {"timestamp": "2024-01-02T14:30:00Z", "open": 1.25, "high": 2, "low": 1, "close": 1.5, "upVolume": 1, "downVolume": 2, "upTicks": 1, "downTicks": 1}


def test_json_envelopes(spark, tmp_path):
    own = {"symbol": "ESH4", "barType": "minute", "barSize": "1", "bars": [BAR, BAR]}
    for i, doc in enumerate((own, {"structuredContent": own}, {"structuredContent": {"structuredContent": own}})):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, indent=1))
    got = readers.responses(spark, str(tmp_path))
    assert got.count() == 6 and got.select("symbol").distinct().count() == 1
    assert {r["source_row_number"] for r in got.collect()} == {0, 1}


def test_csv_and_lines(spark, tmp_path):
    (tmp_path / "q.csv").write_text("session_date,session_usable,open_utc\n2024-01-02,True,2024-01-01 23:00:00\n2024-01-03,maybe,bad\n")
    got = readers.session_quality_csv(spark, str(tmp_path / "q.csv"), times=("open_utc",)).collect()
    assert [(r["session_usable"], r["open_utc"]) for r in got] == [(True, datetime(2024, 1, 1, 23)), (False, None)]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert rows(readers.json_lines(spark, str(tmp_path / "l.jsonl"))) == [(1,), (2,)]
    (tmp_path / "c.csv").write_text("symbol,expiry\nESH4,2024-03-15\nESM4,\n")
    assert [r["expiry"] is None for r in readers.contract_csv(spark, str(tmp_path / "c.csv")).collect()] == [False, True]
    (tmp_path / "s.json").write_text('{"x": {"y": 1}}')
    assert readers.settings(str(tmp_path / "s.json")) == {"x": {"y": 1}}
    assert readers.json_document(spark, str(tmp_path / "s.json")).select("x.y").first()[0] == 1


def test_only_needed_columns_are_read(spark):
    plan = readers.table(spark, DATA, "lineitem", ("l_orderkey", "l_quantity")).where("l_quantity > 10").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "GreaterThan(l_quantity,10" in plan
    assert readers.parquet_facts(readers.table(spark, DATA, "nation"))["rows"] == 25
    assert readers.glob(spark, f"{DATA}/nation.parq*", "some_nations").count() == 25


def test_ingest_is_immutable(tmp_path):
    path = str(tmp_path / "r.json")
    assert sinks.ingest({"b": 1, "a": 2}, path, 1)["status"] == "success"
    assert sinks.ingest({"a": 2, "b": 1}, path, 1)["status"] == "cached_verified"
    with pytest.raises(FileExistsError):
        sinks.ingest({"a": 3}, path, 1)
    assert sinks.ingest({"a": []}, str(tmp_path / "e.json"), 0)["status"] == "empty"
    got = sinks.ingest_batch([("x", {"a": 1}, str(tmp_path / "x.json"), 1), ("y", None, "", 0), ("z", {"a": 9}, path, 1)])
    assert (got["succeeded"], got["missing"], got["failed"]) == (1, 1, 1)
    sinks.append_failures(got["failures"], str(tmp_path / "f.jsonl"))
    assert json.loads((tmp_path / "f.jsonl").read_text())["request_id"] == "z"


def test_ledger(spark):
    old = spark.createDataFrame([("a", "1")], "k string, h string")
    assert rows(sinks.append_unique(old, spark.createDataFrame([("a", "1"), ("b", "2")], "k string, h string"), "k", "h")) == [("b", "2")]
    with pytest.raises(ValueError):
        sinks.append_unique(old, spark.createDataFrame([("a", "3")], "k string, h string"), "k", "h")


def test_retries():
    waits, tries = [], []

    def call():
        tries.append(1)
        if len(tries) < 4:
            raise OSError
        return {"ok": True}

    assert sinks.with_retries(call, wait=waits.append) == {"ok": True} and waits == [1, 2, 4]
    assert sinks.delay(99) == 16


def test_tables_hashes_and_reports(spark, tmp_path):
    df = readers.table(spark, DATA, "nation")
    sinks.write_table(df, str(tmp_path / "t"), ["n_nationkey"], ["n_regionkey"])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sinks.content_hash(back.select(df.columns)) == sinks.content_hash(df.repartition(5))
    assert sinks.content_hash(df)["hash"] != sinks.content_hash(df.withColumn("n_name", F.lit("x")))["hash"]
    sinks.write_csv(df, str(tmp_path / "c"), single=True)
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == spark.read.json(str(tmp_path / "j")).count() == 25
    m = sinks.manifest({"n": df}, {"a": True, "b": False})
    assert m["tables"]["n"]["rows"] == 25 and not m["passed"]
    assert "| n_nationkey |" in sinks.markdown("T", {"x": 1}, {"n": df.orderBy("n_nationkey")})
    a = sinks.artifact("T", {"n": df}, {"n": "SELECT 1"}, cards=[{"dataset": "n"}])
    assert len(a["snapshot"]["datasets"]["n"]) == 25
    with pytest.raises(ValueError):
        sinks.artifact("T", {"n": df}, {}, most_rows=10)
    with pytest.raises(ValueError):
        sinks.artifact("T", {"n": df}, {}, cards=[{"dataset": "z"}])


def test_stream_bars_equal_batch(spark, tmp_path):
    ticks = readers.table(spark, DATA, "events", ("event_id", "ts", "value")).withColumn("ts", F.col("ts").cast("timestamp"))
    ticks.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    query = stream.write_stream(stream.stream_bars(source, 60, "40 days"), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    query.awaitTermination()
    assert spark.read.schema("ts timestamp, open double, high double, low double, close double, total_ticks long").parquet(str(tmp_path / "out")).count() == 0  # nothing is final while rows may be 40 days late
    query = stream.write_stream(stream.stream_bars(source, 60, "0 seconds"), str(tmp_path / "out2"), str(tmp_path / "ck2"), once=True)
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out2"))
    from tidemark.sources import adapters

    batch = adapters.bars_from_events(readers.table(spark, DATA, "events"), 60).select(F.col("ts").cast("timestamp").alias("ts"), "open", "high", "low", "close", "total_ticks")
    assert got.count() >= batch.count() - 1 and got.exceptAll(batch).count() == 0


def test_stream_first_event(spark, tmp_path):
    rows_in = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, i), float(i)) for i in range(6)] + [("b", datetime(2024, 1, 1, 0, 1), 0.5)], "k string, ts timestamp, v double")
    rows_in.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows_in.schema).parquet(str(tmp_path / "in"))
    query = stream.write_stream(stream.first_events(source, "k", "v", 3.0), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("k", "v")) == [("a", 3.0)]


def test_a_failed_write_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(5), path, order=["id"])
    with pytest.raises(Exception, match="no"):
        sinks.write_table(spark.range(5).select(F.raise_error(F.lit("no")).cast("long").alias("id")), path)
    assert spark.read.parquet(path).count() == 5
    sinks.write_table(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7 and not list(tmp_path.glob("t.*.old"))

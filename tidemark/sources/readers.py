"""Scans: Parquet, JSON envelopes and lines, typed CSV, settings, and the guarded loader."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_SCHEMA = "timestamp string, open string, high string, low string, close string, upVolume string, downVolume string, upTicks string, downTicks string"
ENVELOPE = f"symbol string, barType string, barSize string, bars array<struct<{', '.join(f'{c.split()[0]}:string' for c in BAR_SCHEMA.split(', '))}>>"


def table(spark: SparkSession, folder: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A Parquet table or folder of files, of which only the named columns are read."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def glob(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    """All Parquet files under a pattern, as a view too if it gets a name."""
    df = spark.read.parquet(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def guarded(df: DataFrame, splits: Iterable[str], known: Iterable[str], locked: str, unlocked: bool = False, columns: Iterable[str] | None = None, order: str = "timestamp_utc") -> DataFrame:
    """Rows of the named splits, by time. Fails before any plan is made if none is named, one is unknown, the locked one isn't unlocked, or a column isn't plain."""
    names = list(dict.fromkeys(splits))
    if not names or set(names) - set(known):
        raise ValueError(f"splits must be some of {sorted(known)}: {names}")
    if locked in names and not unlocked:
        raise PermissionError(f"{locked} is locked")
    if bad := [c for c in columns or () if not re.fullmatch(r"[A-Za-z_]\w*", c)]:
        raise ValueError(f"not plain column names: {bad}")
    out = df.where(F.col("split").isin(names))
    return (out.select(*columns) if columns else out).orderBy(order)


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Bars of JSON responses, which may be wrapped once or twice in structuredContent: symbol, raw_path, source_row_number and text columns."""
    inner = f"struct<{ENVELOPE.replace(' string', ':string').replace('bars array', 'bars:array')}>"
    schema = f"{ENVELOPE}, structuredContent struct<structuredContent:{inner},symbol:string,barType:string,barSize:string,bars:{ENVELOPE.split('bars ')[1]}>"
    raw = spark.read.schema(schema).json(path, multiLine=True).withColumn("raw_path", F.input_file_name())
    pick = lambda c: F.coalesce(f"structuredContent.structuredContent.{c}", f"structuredContent.{c}", c)
    return raw.select("raw_path", pick("symbol").alias("symbol"), F.posexplode(pick("bars")).alias("source_row_number", "bar")).select("symbol", "raw_path", "source_row_number", "bar.*")


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank ones are skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def tolerant_boolean(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)) == "true", F.lit(False))


def session_quality_csv(spark: SparkSession, path: str, dates=("session_date",), times=(), booleans=("session_usable", "expected_session")) -> DataFrame:
    """A CSV of session records: dates, UTC times (null if malformed) and booleans (anything but true is false)."""
    raw = spark.read.csv(path, header=True)
    typed = {c: F.try_to_date(F.col(c)) if hasattr(F, "try_to_date") else F.try_to_timestamp(F.col(c)).cast("date") for c in dates if c in raw.columns}
    typed |= {c: F.try_to_timestamp(F.col(c)).cast("timestamp_ntz") for c in times if c in raw.columns}
    typed |= {c: tolerant_boolean(F.col(c)) for c in booleans if c in raw.columns}
    return raw.withColumns(typed)


def contract_csv(spark: SparkSession, path: str) -> DataFrame:
    """A contract inventory; empty fields are null."""
    raw = spark.read.csv(path, header=True, nullValue="")
    return raw.withColumns({c: F.col(c).cast("date") for c in raw.columns if c.endswith("_date") or c in ("expiry", "first_day", "last_day")})


def settings(path: str) -> dict:
    """A YAML or JSON file of settings, on the driver."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def parquet_facts(df: DataFrame) -> dict:
    """Rows, number of columns and schema of a table; Spark answers the count from the file footers."""
    return {"rows": df.count(), "columns": len(df.columns), "schema": {f.name: f.dataType.simpleString() for f in df.schema}}

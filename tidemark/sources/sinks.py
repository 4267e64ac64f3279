"""Sinks: tables, CSV and JSON, immutable ingest with checksums, ledgers, manifests and bounded reports."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import tempfile
import uuid
from collections.abc import Callable, Iterable, Mapping

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, order: Iterable[str] = (), partition_by: Iterable[str] = (), row_group_bytes: int | None = None) -> None:
    """zstd Parquet in time order within files: ranges of the order, sorted in tasks; no single task sees all rows.

    The table is written beside its place first. Only a whole one is moved there, the old one aside until then and put back if the move fails, so a
    failed job loses neither.
    """
    order, by = list(order), list(partition_by)
    if order:
        df = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    own = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    if row_group_bytes:
        out = out.option("parquet.block.size", row_group_bytes)
    (out.partitionBy(*by) if by else out).parquet(f"{own}.new")
    _swap(df, f"{own}.new", path, f"{own}.old")


def _swap(df: DataFrame, new: str, path: str, aside: str) -> None:
    spark = df.sparkSession
    here, fresh, old = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, new, aside))
    files = here.getFileSystem(spark._jsc.hadoopConfiguration())
    was = files.exists(here)
    if was and not files.rename(here, old):
        raise OSError(f"{path} can't be moved")
    if not files.rename(fresh, here):
        if was:
            files.rename(old, here)
        raise OSError(f"{new} can't be moved to {path}")
    if was:
        files.delete(old, True)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; one file only for a small report."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def replace_file(path: str, data: bytes) -> None:
    """Writes beside the file and renames, so that readers see the old or the new one whole."""
    handle, own = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "wb") as f:
        f.write(data)
    os.replace(own, path)


def canonical(document) -> bytes:
    return json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def sha256_file(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def ingest(document: Mapping, path: str, rows: int) -> dict:
    """Stores a response once: a second equal one is verified, a different one fails. No rows: status empty."""
    data = canonical(document)
    found = {"path": path, "sha256": hashlib.sha256(data).hexdigest(), "rows": rows}
    if os.path.exists(path):
        if sha256_file(path) != found["sha256"]:
            raise FileExistsError(path)
        return found | {"status": "cached_verified"}
    replace_file(path, data)
    return found | {"status": "success" if rows else "empty"}


def append_unique(ledger: DataFrame | None, new: DataFrame, key: str, checksum: str) -> DataFrame:
    """The rows of `new` whose key the ledger lacks; fails if a known key has another checksum."""
    if ledger is None:
        return new
    old = ledger.select(F.col(key).alias("_key"), F.col(checksum).alias("_sum"))
    if not new.join(old, F.col(key) == F.col("_key")).where(~F.col(checksum).eqNullSafe(F.col("_sum"))).isEmpty():
        raise ValueError(f"a {key} is known with another {checksum}")
    return new.join(old, F.col(key) == F.col("_key"), "left_anti")


def append_failures(failures: Iterable[Mapping], path: str) -> None:
    with open(path, "a", encoding="utf-8") as f:
        for x in failures:
            f.write(json.dumps(dict(x), sort_keys=True) + "\n")


def with_retries(call: Callable[[], dict], backoff=(1, 2, 4, 8, 16), wait: Callable[[float], None] | None = None, attempts: int = 5) -> dict:
    """Calls until it succeeds; waits by the list of seconds, whose last repeats."""
    for i in range(attempts):
        try:
            return call()
        except OSError:
            if i == attempts - 1:
                raise
            if wait:
                wait(delay(i, backoff))
    raise ValueError("attempts must be at least 1")


def delay(attempt: int, backoff=(1, 2, 4, 8, 16)) -> int:
    return backoff[min(max(attempt, 0), len(backoff) - 1)]


def ingest_batch(items: Iterable[tuple[str, Mapping | None, str, int]]) -> dict:
    """(id, document, path, rows) one after the other: counts of what was stored, missing or failed, and the ledger's rows."""
    out = {"succeeded": 0, "missing": 0, "failed": 0, "ledger": [], "failures": []}
    for name, document, path, rows in items:
        if document is None:
            out["missing"] += 1
            continue
        try:
            out["ledger"].append({"request_id": name} | ingest(document, path, rows))
            out["succeeded"] += 1
        except OSError as e:
            out["failed"] += 1
            out["failures"].append({"request_id": name, "error": type(e).__name__})
    return out


def content_hash(df: DataFrame) -> dict:
    """Rows and a hash that doesn't depend on their order: equal for an equal table, however it is partitioned."""
    cols = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in sorted(df.columns)]
    got = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("h")).first()
    return {"rows": got["n"], "hash": str(got["h"] or 0)}


def manifest(tables: Mapping[str, DataFrame], checks: Mapping[str, bool], inputs: Mapping[str, str] = {}) -> dict:  # noqa: B006
    """What a run made and from what: shapes, hashes, versions, and whether all checks held."""
    return {
        "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__},
        "inputs": dict(inputs),
        "tables": {name: content_hash(df) | {"columns": len(df.columns), "schema": [[f.name, f.dataType.simpleString()] for f in df.schema]} for name, df in tables.items()},
        "checks": dict(checks),
        "passed": all(checks.values()),
    }


def markdown(title: str, summary: Mapping, tables: Mapping[str, DataFrame], rows: int = 50) -> str:
    """A report: a list of facts and the first rows of each table, which are already in order."""
    out = [f"# {title}", "", *(f"- {k}: {v}" for k, v in summary.items())]
    for name, df in tables.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(rows).collect()]
    return "\n".join(out) + "\n"


def artifact(title: str, datasets: Mapping[str, DataFrame], sources: Mapping[str, str], cards: list[dict] = (), charts: list[dict] = (), tables: list[dict] = (), most_datasets: int = 50, most_rows: int = 2000) -> dict:
    """A report document of bounded size: each dataset's rows (fewer than most_rows, else it fails) and the SQL that they come from."""
    if len(datasets) > most_datasets:
        raise ValueError("too many datasets")
    snapshot = {}
    for name, df in datasets.items():
        got = df.limit(most_rows).collect()
        if len(got) >= most_rows:
            raise ValueError(f"{name} has too many rows for a report")
        snapshot[name] = [json.loads(json.dumps(r.asDict(recursive=True), default=str)) for r in got]
    known = set(snapshot)
    if bad := [x for x in [*cards, *charts, *tables] if x.get("dataset") not in known]:
        raise ValueError(f"no such dataset: {bad}")
    return {"title": title, "manifest": {"blocks": list(snapshot), "cards": list(cards), "charts": list(charts), "tables": list(tables)}, "snapshot": {"datasets": snapshot}, "sources": dict(sources)}

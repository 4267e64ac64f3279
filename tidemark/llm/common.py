"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Words are runs of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows, and bytes beyond which no row is added, that go to Python at once.
ROWS, BATCH = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES, BATCH_BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

#: Rows up to which a side whose rows are a few numbers may be broadcast; it is counted first.
BROADCAST_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark, "_tidemark_dir", None)
    if own is None:
        own = spark._tidemark_dir = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return own


def settle(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder and read from there, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: smaller than a checkpoint, and read by column."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that `written` made and that no later step reads."""
    spark = df.sparkSession
    for place in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; otherwise a shuffled join, which AQE splits where a key is hot."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 0 mod 5; a null id is in the training part."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def modest(df: DataFrame) -> DataFrame:
    """df; its session from now on sends Python at most ROWS rows or about BYTES at once, as texts may be long and both sides hold what is sent."""
    conf = df.sparkSession.conf
    if int(conf.get(BATCH)) > ROWS or int(conf.get(BATCH)) <= 0:
        conf.set(BATCH, ROWS)
    if conf.get(BATCH_BYTES) != str(BYTES):
        conf.set(BATCH_BYTES, str(BYTES))
    return df


def tidy() -> None:
    """Gives what a task no longer needs back to the system, since a worker waits for the next task with it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries don't have it
        ctypes.CDLL(None).malloc_trim(0)


_kept: list = [None, None]


def kept(key: tuple, make: Callable[[], T]) -> T:
    """What `make` gives, kept in this Python worker for its later tasks: one thing at a time, so that stages' memories don't add up."""
    if _kept[0] != key:
        _kept[:] = [None, None]
        _kept[:] = [key, make()]
    return _kept[1]


def forget() -> None:
    """Gives up what an earlier stage has kept in this Python worker."""
    if _kept[0] is not None:
        _kept[:] = [None, None]
        tidy()


def parts(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a part has about `most` bytes of text in the column, and one row at least."""
    for batch in batches:
        size = pc.binary_length(batch[column].cast(pa.large_binary())).to_pylist()
        at, total = 0, 0
        for i, n in enumerate(size):
            if total and total + (n or 0) > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n or 0
        if at < len(size):
            yield batch.slice(at)
    tidy()


def gathered(batches: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """What `parts` gives, put together again so far as the text in the column stays within `most` bytes: words that batches share are looked up once."""
    held: list[pa.RecordBatch] = []
    total = 0
    for part in parts(batches, column):
        size = pc.sum(pc.binary_length(part[column].cast(pa.large_binary()))).as_py() or 0
        if held and total + size > most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, total = [], 0
        held.append(part)
        total += size
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()

from __future__ import annotations

import pytest

from ..conftest import DATA


@pytest.fixture
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, and columns whose names clash with inner ones."""
    long = " ".join(f"word{i % 977} filler" for i in range(60_000)) + "\nend"
    data = [(1, "the same text here again now", "a"), (1, "the same text here again now", "a"), (2, None, None), (3, "", "a"), (4, " \t\n ", "b"), (None, "no id at all but words", "b"), (5, long, None), (6, "x", "a"), (-7, "the same text here again now", "a"), (8, "日本語 テキスト é ñ　ü", "a")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    clash = {c: F.lit("?") for c in ("size", "score", "_id", "_hash", "_key", "cls", "sig", "n", "reps", "target", "_drop", "component_id", "grp", "_rest", "_first", "shard", "prefix", "unit")}
    return df.withColumns(clash).withColumn("lang", F.when(F.col("doc_id") > 3, "en"))


@pytest.fixture
def empty(odd):
    return odd.limit(0)


def texts(spark, data, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(data, schema)


__all__ = ["DATA", "texts"]

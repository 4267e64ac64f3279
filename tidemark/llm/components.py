"""Connected components of a graph that is held as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Links, of two numbers each, that one task may hold.
AT_ONCE = 250_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links a[i] - b[i]: each node that isn't the least of its component, and that least node."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    up, down = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[up], root[down])
        new = root.copy()
        np.minimum.at(new, root[up], low)
        np.minimum.at(new, root[down], low)
        np.minimum.at(new, up, low)
        np.minimum.at(new, down, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as those to the least node, a stretch at a time."""
    for batch in batches:
        a, b = forest(batch["a"].to_numpy(), batch["b"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b["a"].to_numpy(), b["b"].to_numpy()) for b in batches]
    if held:
        a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["node", "root"])


def components(links: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """links (a long, b long) -> node, root: the least node of its component, for each node that isn't its component's least.

    Large-star and small-star steps by turns: each links nodes to the least neighbour that they know. Minima are
    aggregates, so a node with very many links is summed up in each task first, and the joins back can be split where
    it is hot. Each round's links are kept in the shared folder. Links of a node to itself, repeated ones and nulls are fine.
    Up to `at_once` links, which are counted first, take a single pass in one task of an executor instead.
    """
    e = links.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = settle(e.mapInArrow(_shrink, "a long, b long").distinct())
    if e.limit(at_once + 1).count() <= at_once:
        return settle(e.coalesce(1).mapInArrow(_whole, "node long, root long"))
    state = None
    while True:
        # here a > b always
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(e.join(least, "a").select("a", F.col("m").alias("b"))).where("a != b").distinct()
        large = settle(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        e = settle(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now

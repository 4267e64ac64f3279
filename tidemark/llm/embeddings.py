"""Near-duplicate vectors through an inverted multi-index: codebooks of both halves, cells by pairs of codes, and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import modest, read, settle, small, written
from .components import components, forest

COSINE, RECALL = 0.95, 0.99
#: Classes that codebooks are fitted on (expected number), or CODE_ROWS for each code if that is more, and vectors that a cell has on average.
SAMPLE, CODE_ROWS, FILL = 20_000, 4, 12
#: Of the sample, vectors that the traversal's length is measured with at first, and true partners to be seen; PARTNERS made ones for each as well.
PROBED, SEEN, PARTNERS = 400, 1_000, 4
#: Rounds of fitting, cells that a vector visits at least, rows of a block, and classes of a length that are compared without an index.
ROUNDS, LEAST, BLOCK, FEW = 8, 12, 1024, 1024


def _codes(x: np.ndarray, k: int) -> np.ndarray:
    """k centres of the rows of x."""
    start = np.random.default_rng(7).choice(len(x), min(k, len(x)), replace=False)
    centres = x[np.sort(start)].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([_distances(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


def codes_for(rows: int) -> int:
    """Codes of a half, so that a cell has about FILL of so many rows."""
    return max(2, round((rows / FILL) ** 0.5))


class MultiIndex:
    """A cell is a pair of codes, one for each half of a vector of length 1."""

    def __init__(self, left: np.ndarray, right: np.ndarray, visits: int = LEAST):
        self.left, self.right, self.visits, self._made = left, right, visits, None

    @classmethod
    def fit(cls, x: np.ndarray, rows: int) -> MultiIndex:
        """Codebooks from the sampled rows x; their size follows the number of all rows."""
        half = x.shape[1] // 2
        k = codes_for(rows)
        return cls(_codes(x[:, :half], k), _codes(x[:, half:], k))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.left.shape[1]
        return _distances(x[:, :half], self.left), _distances(x[:, half:], self.right)

    def cells(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """For each row the cells in the order in which a multi-sequence traversal visits them, by the sum of both halves' distances; the first is its own.

        The t-th cell has codes of ranks i and j with (i + 1) * (j + 1) <= t, so only those pairs are ordered.
        """
        visits = min(self.visits if visits is None else visits, len(self.left) * len(self.right))
        a, b = self.halves(x)
        near_a, near_b = (_least(d, min(visits, d.shape[1])) for d in (a, b))
        i, j = self._pairs(visits, near_a.shape[1], near_b.shape[1])
        sums = np.take_along_axis(a, near_a, 1)[:, i] + np.take_along_axis(b, near_b, 1)[:, j]
        first = np.argsort(sums, axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(near_a, i[first], 1) * len(self.right) + np.take_along_axis(near_b, j[first], 1)

    def _pairs(self, visits: int, most_a: int, most_b: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of ranks that the first `visits` cells may have, made once."""
        if self._made is None or self._made[0] != (visits, most_a, most_b):
            counts = [min(most_b, visits // (i + 1)) for i in range(most_a)]
            self._made = ((visits, most_a, most_b), np.repeat(np.arange(most_a), counts), np.concatenate([np.arange(n) for n in counts]))
        return self._made[1:]

    def ranks(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells row by row come before the given ones."""
        a, b = self.halves(x)
        out = np.empty(len(x), np.int64)
        for r in range(len(x)):
            s = a[r, cell[r] // len(self.right)] + b[r, cell[r] % len(self.right)]
            out[r] = np.searchsorted(np.sort(b[r]), s - a[r] - 1e-12).sum()
        return out


def _least(d: np.ndarray, n: int) -> np.ndarray:
    """The places of the n least numbers of each row, in order; equal ones by place."""
    if n * 4 > d.shape[1]:
        return np.argsort(d, axis=1, kind="stable")[:, :n]
    some = np.sort(np.argpartition(d, n - 1, axis=1)[:, :n], axis=1)
    return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of length 1, in double precision; those of a single component get another, 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    if x.shape[1] == 1:
        x = np.concatenate((x, np.zeros_like(x)), axis=1)
    # scaled by the largest component first, so that no square overflows or vanishes
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _enough(ranks: list[tuple[int, int]], recall: float) -> int:
    """The cells to visit so that a share `recall` of partners (rank, number of partners with it) is found."""
    need, seen = recall * sum(n for _, n in ranks), 0
    for r, n in sorted(ranks):
        seen += n
        if seen >= need:
            return r + 1
    return 0


def _made(index: MultiIndex, x: np.ndarray, cosine: float) -> list[tuple[int, int]]:
    """Ranks of partners that are made for the rows x: at the cosine itself, the hardest place, in random directions. A pair is found if one visits the other's cell."""
    rng = np.random.default_rng(11)
    q = np.repeat(x, PARTNERS, axis=0)
    away = rng.normal(size=q.shape)
    away -= (away * q).sum(1, keepdims=True) * q
    size = np.sqrt((away * away).sum(1, keepdims=True))
    other = cosine * q + (1 - cosine * cosine) ** 0.5 * away / np.where(size > 0, size, 1)
    ranks = np.minimum(index.ranks(q, index.cells(other, 1)[:, 0]), index.ranks(other, index.cells(q, 1)[:, 0]))
    return [(int(r), int(n)) for r, n in zip(*np.unique(ranks, return_counts=True), strict=True)]


def _true(classes: DataFrame, index: MultiIndex, probed: np.ndarray, ids: np.ndarray, cosine: float) -> list[tuple[int, int]]:
    """Ranks of the true partners of the given rows among all rows."""
    known = classes.sparkSession.sparkContext.broadcast((index, probed, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, every, names = known.value
        counts: dict[int, int] = {}
        for batch in batches:
            x, n = _matrix(batch["vec"]), batch["cls"].to_numpy()
            for at in range(0, len(every), BLOCK):
                q = every[at : at + BLOCK]
                i, j = np.nonzero((q @ x.T >= cosine) & (names[at : at + BLOCK, None] != n))
                for k in range(0, len(i), BLOCK):
                    a, b = q[i[k : k + BLOCK]], x[j[k : k + BLOCK]]
                    for r in np.minimum(own.ranks(a, own.cells(b, 1)[:, 0]), own.ranks(b, own.cells(a, 1)[:, 0])).tolist():
                        counts[r] = counts.get(r, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["r", "n"])

    rows = classes.select("cls", "vec").mapInArrow(run, "r long, n long").groupBy("r").agg(F.sum("n").alias("n")).collect()
    known.unpersist()
    return [(r["r"], r["n"]) for r in rows]


def _visits(classes: DataFrame, index: MultiIndex, x: np.ndarray, ids: np.ndarray, cosine: float, recall: float) -> int:
    """The cells to visit so that `recall` of partners is found: of those made for PROBED rows of the sample, and of true ones among all rows.

    Four times as many rows as before are probed for true partners until SEEN are known or the whole sample has been.
    """
    at = np.random.default_rng(5).permutation(len(x))
    need = max(LEAST, _enough(_made(index, x[at[:PROBED]], cosine), recall))
    true: list[tuple[int, int]] = []
    done, upto = 0, PROBED
    while done < len(at) and sum(n for _, n in true) < SEEN:
        own = at[done:upto]
        true += _true(classes, index, x[own], ids[own], cosine)
        done, upto = upto, 4 * upto
    return max(need, _enough(true, recall))


def _probes(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            cells = own.cells(_matrix(batch["vec"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

    return run


#: What rows meet by: the length of their vectors, a cell, and the shares of its postings and queries.
UNIT = ["dims", "cell", "p", "q"]


def _links(cosine: float):
    """Rows of one unit follow each other, postings (side 0) before queries (side 1): gives what each adds to a class's links, and links that join the same classes as all links."""

    def unit(rows: pa.Table) -> tuple[np.ndarray, ...]:
        side = rows["side"].to_numpy()
        ids, n, home = rows["cls"].to_numpy(), rows["n"].to_numpy(), rows["home"].to_numpy()
        split = int(np.searchsorted(side, 1))
        if not split or split == len(ids):
            return (np.empty(0, np.int64),) * 4
        x = _matrix(rows["vec"].combine_chunks())
        visited = rows["cells"].combine_chunks()[:split].flatten().to_numpy().reshape(split, -1)
        out_id, out_n, link_a, link_b = [], [], [], []
        for at in range(split, len(ids), BLOCK):
            q = slice(at, min(at + BLOCK, len(ids)))
            hit = (x[q] @ x[:split].T >= cosine) & (ids[q][:, None] != ids[:split])
            i, j = np.nonzero(hit)
            if len(i):
                i = i + at
                out_id.append(ids[i])
                out_n.append(n[j])
                # the posting doesn't find this query by itself if it doesn't visit the query's cell
                alone = np.concatenate([~(visited[j[k : k + 8192]] == home[i[k : k + 8192], None]).any(1) for k in range(0, len(i), 8192)])
                out_id.append(ids[j[alone]])
                out_n.append(n[i[alone]])
                a, b = forest(ids[i], ids[j])
                link_a.append(a)
                link_b.append(b)
        if not out_id:
            return (np.empty(0, np.int64),) * 4
        names, inverse = np.unique(np.concatenate(out_id), return_inverse=True)
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, inverse, np.concatenate(out_n))
        a, b = forest(np.concatenate(link_a), np.concatenate(link_b))
        return names, sums, a, b

    def flush(tables: list[pa.Table]) -> pa.RecordBatch | None:
        rows = pa.concat_tables(tables)
        names, sums, a, b = unit(rows)
        if not len(names):
            return None
        blank = np.zeros(len(a), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in ((names, a), (sums, blank), (np.full(len(names), -1), b))] + [pa.array([False] * len(names) + [True] * len(a))], names=["cls", "n", "other", "link"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        now = None
        for batch in batches:
            units = np.stack([batch[c].to_numpy() for c in UNIT], axis=1)
            cuts = [0, *(np.flatnonzero((units[1:] != units[:-1]).any(1)) + 1).tolist(), len(units)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and tuple(units[a]) != now:
                    if (out := flush(held)) is not None:
                        yield out
                    held = []
                now = tuple(units[a])
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        if held and (out := flush(held)) is not None:
            yield out

    return run


def _indexed(classes: DataFrame, rows: int, cosine: float, recall: float, sample: int) -> DataFrame:
    """classes (cls, n, vec, dims) of one length with `cells`, those that each visits: its own first."""
    share = max(sample, CODE_ROWS * codes_for(rows)) / rows
    picked = classes.where(F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(1_000_003)) < 1_000_003 * min(1.0, share)).select("cls", "vec").orderBy("cls").toArrow()
    if not len(picked):
        picked = classes.select("cls", "vec").orderBy("cls").limit(sample).toArrow()
    x = _matrix(picked["vec"].combine_chunks())
    index = MultiIndex.fit(x, rows)
    index.visits = min(_visits(classes, index, x, picked["cls"].to_numpy(), cosine, recall), len(index.left) * len(index.right))
    schema = StructType([*classes.schema.fields, StructField("cells", ArrayType(LongType()))])
    return classes.mapInArrow(_probes(classes.sparkSession.sparkContext.broadcast(index)), schema)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, n_links, component_id, kept.

    Vectors link at a cosine of at least `cosine`; only vectors of equal length are compared. Equal ones are one class, so copies are
    counted and not compared. Classes of a length meet in the cells of its index that one of them visits; a cell with many is dealt out in blocks of
    postings and of queries, and a block gives counts and a spanning forest, not its pairs. Codebooks are fitted on about `sample`
    classes, more where there are many codes, and grow with the rows; all classes are indexed. The number of visited cells is what finds `recall` of pairs exactly at the
    cosine that are made for PROBED classes, and of true pairs that probing sees. Lengths of FEW classes at most have one cell, without loss.

    Vectors that are null, empty, zero, hold a null or a component that isn't finite link with nothing; so do rows without an
    id, whose component is null. Rows with equal ids count as often as they occur. An empty table gives no rows.
    """
    modest(vectors)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.withColumns({"fine": fine, "h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit("second"), "vec")})
    classes = rows.where("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("cls"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = written(classes.withColumn("dims", F.size("vec")), "classes")
    lengths = {r["dims"]: r["count"] for r in classes.groupBy("dims").count().where("count > 1").collect()}
    slim = classes.select("cls", "n", "vec", "dims")
    few = slim.join(small(slim.groupBy("dims").count().where(f"count BETWEEN 2 AND {FEW}").select("dims")), "dims").select(slim.columns)
    found = few.withColumn("cells", F.array(F.lit(0).cast("long")))
    for dims in sorted(d for d, n in lengths.items() if n > FEW):
        found = found.unionByName(_indexed(slim.where(F.col("dims") == dims), lengths[dims], cosine, recall, sample))
    found = written(found, "cells").withColumn("home", F.element_at("cells", 1))
    posts = found.groupBy("dims", F.col("home").alias("cell")).agg(F.count("*").alias("posts"))
    asks = found.select("dims", F.explode("cells").alias("cell")).groupBy("dims", "cell").agg(F.count("*").alias("asks"))
    blocks = [F.ceil(F.col("posts") / BLOCK).cast("int").alias("pb"), F.ceil(F.col("asks") / (8 * BLOCK)).cast("int").alias("qb")]
    plan = small(settle(asks.join(posts, ["dims", "cell"]).select("dims", "cell", *blocks)))
    # a posting has its visited cells with it, a query only its own
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side0 = found.withColumn("cell", F.col("home")).join(plan, ["dims", "cell"])
    side0 = side0.withColumns({"p": F.pmod(F.xxhash64("cls"), F.col("pb")).cast("int"), "q": upto("qb"), "side": F.lit(0)})
    side1 = found.withColumn("cell", F.explode("cells")).withColumn("cells", F.lit(None).cast("array<bigint>")).join(plan, ["dims", "cell"])
    side1 = side1.withColumns({"q": F.pmod(F.xxhash64("cls", F.lit(2)), F.col("qb")).cast("int"), "p": upto("pb"), "side": F.lit(1)})
    both = side0.unionByName(side1).select(*UNIT, "side", "cls", "n", "vec", "home", "cells")
    both = both.repartition(*UNIT).sortWithinPartitions(*UNIT, "side")
    got = written(both.mapInArrow(_links(cosine), "cls long, n long, other long, link boolean"), "links")
    counts = got.where("NOT link").groupBy("cls").agg(F.sum("n").alias("others"))
    roots = components(got.where("link").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    by_class = classes.select("h1", "h2", "cls", "n").join(counts, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left")
    by_class = settle(by_class.select("h1", "h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("_links"), F.coalesce("root", "cls").alias("_root")))
    out = rows.withColumn("h1", F.when(F.col("fine"), F.col("h1"))).select("vec_id", "h1", "h2").join(small(by_class), ["h1", "h2"], "left")
    own = F.coalesce("_root", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(False)).alias("kept"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


#: All pairs of rows, and what is reachable.
OP4_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x, row_number() OVER () AS r FROM embeddings),
f AS (
  SELECT r, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS norm FROM v
  WHERE vec_id IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS (
  SELECT p.r AS a, q.r AS b FROM f p JOIN f q
  ON p.r <> q.r AND len(p.x) = len(q.x) AND list_sum(list_transform(list_zip(p.x, q.x), lambda z: z[1] * z[2])) >= 0.95 * p.norm * q.norm),
reach AS (SELECT r, r AS other FROM v UNION SELECT reach.r, l.b FROM reach JOIN l ON reach.other = l.a),
m AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.other = v.r GROUP BY reach.r),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, m.component_id, coalesce(m.component_id = v.vec_id, false) AS kept
FROM v JOIN m ON v.r = m.r LEFT JOIN n ON v.r = n.a
"""

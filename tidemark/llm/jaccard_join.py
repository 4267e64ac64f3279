"""Near-duplicate documents by an exact Jaccard join of their shingle sets: a grouped prefix join, and components of its links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, forget, modest, parts, read, settle, small, written
from .components import components

SHINGLE, SIMILARITY = 4, 85  # words; hundredths
#: Shingles in more documents than this are told apart by frequency, and so many of them at most: the sole broadcast that grows, up to this bound.
COMMON, MOST_COMMON = 8, 1_500_000
#: Bits of a shingle's hash that its frequency is counted by, and shingles that a task counts at once.
COUNT_BITS, COUNT_AT_ONCE = 40, 1_500_000
#: Round by round, how many groups ahead in a shingle's order each meets, and partners that a group is compared with at most, before
#: all that may still join two components is compared. Rounds after the first look at shingles of components with LARGE members.
AHEAD, PARTNERS, LARGE = (1, 12, 16), (6, 64, 96), 8
SEGMENT = 1 << 18
#: Documents that hold a shingle, beyond which its postings are dealt over several tasks.
HOT = 20_000
#: Shingles that sets may have in all to be broadcast: 24 MB.
BROADCAST_ITEMS = 3_000_000

_U = np.uint64
#: Bytes of a word whose random numbers are summed at once.
STRETCH = 64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A random number for each place in a stretch and byte; A-Z as a-z.
_RANDOM = mix(np.arange(1, STRETCH * 256 + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)).reshape(STRETCH, 256)
_RANDOM[:, 65:91] = _RANDOM[:, 97:123]
_RANDOM = _RANDOM.ravel()
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words in these bytes, and where they start.

    Each byte has a random number for its place; the sum over a stretch of a word is mixed with the stretch's number, and the sum of
    those with the word's length. Sums of independent numbers, mixed before they are added up again, have no period or sign
    that words could be built on; two different words have equal hashes with a probability of about 2 ** -64.
    """
    gap = _GAP[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, _U), start
    size = end - start
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)  # in its word, for each byte of a word
    numbers = _RANDOM[(place & (STRETCH - 1)) << 8 | data[~gap]]
    first = np.flatnonzero((place & (STRETCH - 1)) == 0)
    sums = mix(np.add.reduceat(numbers, first) + (place[first] >> 6).astype(_U) * _U(0x9E3779B97F4A7C15))
    stretches = -(-size // STRETCH)
    return mix(np.add.reduceat(sums, np.cumsum(stretches) - stretches) + size.astype(_U) * _U(0xA0761D6478BD642F)), start


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    got = words[: len(words) - k + 1].copy()
    for i in range(1, k):
        got = mix(got * _U(0xE7037ED1A0B428DB) + words[i : len(words) - k + 1 + i])
    return got


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> list[np.ndarray]:
    """For each text its distinct shingles' hashes, ascending; a text of fewer words has its whole sequence as one."""
    out: list[np.ndarray] = []
    raw = [(x or "").encode("utf-8", "replace") for x in texts]
    at = 0
    while at < len(raw):
        upto, size = at + 1, len(raw[at])
        while upto < len(raw) and size + len(raw[upto]) < SEGMENT:
            size += len(raw[upto]) + 1
            upto += 1
        if upto == at + 1 and size > SEGMENT:
            words, own = [], raw[at]
            while own:  # a long text, cut at gaps
                cut = SEGMENT
                while cut < len(own) and not _GAP[own[cut]]:
                    cut += 1
                words.append(word_hashes(np.frombuffer(own[:cut], np.uint8))[0])
                own = own[cut:]
            each = [np.concatenate(words)]
        else:
            joined = np.frombuffer(b"\n".join(raw[at:upto]), np.uint8)
            words, start = word_hashes(joined)
            ends = np.cumsum([len(x) + 1 for x in raw[at:upto]])
            each = np.split(words, np.searchsorted(start, ends[:-1]))
        for w in each:
            if len(w) >= k:
                out.append(np.unique(_runs(w, k)))
            else:
                out.append(_runs(w, len(w)) ^ _U(len(w)) if len(w) else np.empty(0, _U))
        at = upto
    return out


def least_overlap(n, similarity: int = SIMILARITY):
    """The shingles that a set of n shares at least with any set it links to."""
    return -(-similarity * n // 100)


def frequencies(documents: DataFrame, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes' top bits of shingles that many documents hold, ascending, and in how many.

    Every shingle of every document is counted. A task sorts the top bits of its shingles and sends them as differences, three or
    four bytes each, to the task that counts their range. Two shingles with the same bits are counted together, which
    can only put them later in the order. Of the counts above COMMON the greatest MOST_COMMON at most are kept.
    """
    spark = documents.sparkSession
    bits = max(4, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())

    def pack(keys: np.ndarray) -> Iterator[tuple[int, bytes]]:
        keys = np.sort(keys)
        cuts = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=_U) << _U(COUNT_BITS - bits))
        for p in range(1 << bits):
            own = keys[cuts[p] : cuts[p + 1]]
            if len(own):
                gaps = np.diff(own, prepend=_U(p) << _U(COUNT_BITS - bits)).astype("<u8")
                wide = max(1, (int(gaps.max()).bit_length() + 7) // 8)
                yield p, bytes([wide]) + gaps.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            rows = list(pack(np.concatenate(held)))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["part", "keys"])

        for batch in parts(batches, "text", SEGMENT):
            for own in shingle_sets(batch["text"].to_pylist(), k):
                held.append(own >> _U(64 - COUNT_BITS))
                n += len(own)
            if n >= COUNT_AT_ONCE:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def unpack(part: int, data: bytes) -> np.ndarray:
        planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
        gaps = np.zeros((planes.shape[1], 8), np.uint8)
        gaps[:, : data[0]] = planes.T
        return np.cumsum(gaps.view("<u8").ravel()) + (_U(part) << _U(COUNT_BITS - bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unpack(p, b) for batch in batches for p, b in zip(batch["part"].to_pylist(), batch["keys"].to_pylist(), strict=True)]
        if held:
            keys = np.sort(np.concatenate(held))
            del held
            edge = np.flatnonzero(np.diff(keys, prepend=keys[0] + _U(1), append=keys[-1] + _U(1)))
            n = np.diff(edge)
            many = n > COMMON
            yield pa.RecordBatch.from_arrays([pa.array(keys[edge[:-1]][many].astype(np.int64)), pa.array(n[many].astype(np.int64))], names=["key", "n"])

    sent = documents.select("text").mapInArrow(send, "part int, keys binary").repartition(1 << bits, "part")
    counts = written(sent.mapInArrow(count, "key long, n long"), "frequencies")
    level, total = COMMON, 0
    # counts by power of two, from the greatest: at most 64 rows
    for row in counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("c")).orderBy(F.col("p").desc()).collect():
        if total + row["c"] > MOST_COMMON:
            level = 1 << (row["p"] + 1)
            break
        total += row["c"]
    table = counts.where(F.col("n") >= level).toArrow()
    keys, n = table["key"].to_numpy().astype(_U), table["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def prefixes(documents: DataFrame, common: tuple[np.ndarray, np.ndarray], k: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n, s1, s2 (a set's size and signature), prefix: its rarest shingles, one of which any linked set has in its own."""
    known = documents.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        keys, counts = known.value
        for batch in parts(batches, "text", SEGMENT):
            n, s1, s2, prefix = [], [], [], []
            for own in shingle_sets(batch["text"].to_pylist(), k):
                n.append(len(own))
                s1.append(int(own.sum(dtype=_U)))
                s2.append(int(mix(own + _U(0x8EBC6AF09C88C6E3)).sum(dtype=_U)))
                first = len(own) - least_overlap(len(own), similarity) + 1 if len(own) else 0
                if len(keys) and len(own):
                    top = own >> _U(64 - COUNT_BITS)
                    at = np.minimum(np.searchsorted(keys, top), len(keys) - 1)
                    seen = np.where(keys[at] == top, counts[at], 0)
                    own = own[np.lexsort((own, seen))] if seen.any() else own
                prefix.append(own[:first].view(np.int64))
            as_long = lambda x: pa.array(np.array(x, _U).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), as_long(s1), as_long(s2), pa.array(prefix, pa.list_(pa.int64()))], names=["doc_id", "n", "s1", "s2", "prefix"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, prefix array<bigint>")


def _sets(documents: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """wanted (cls) -> cls, items: the sets of these documents, made anew from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in parts(batches, "text", SEGMENT):
            got = [x.view(np.int64) for x in shingle_sets(batch["text"].to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([batch["cls"], pa.array(got, pa.list_(pa.int64()))], names=["cls", "items"])

    docs = documents.select(F.col("doc_id").cast("long").alias("_id"), "text").join(small(wanted), F.col("_id") == F.col("cls"))
    return docs.select("cls", "text").mapInArrow(run, "cls long, items array<bigint>")


def _enough(shared: Column, a: Column, b: Column, similarity: int) -> Column:
    """similarity <= 100 * shared / union, in whole numbers."""
    return (100 + similarity) * shared >= similarity * (a + b)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Of pairs (a, b) those that link. First the pairs get b's set; those of one a then meet its set, which is sent once."""
    few = (sets.agg(F.sum(F.array_size("items"))).first()[0] or 0) <= BROADCAST_ITEMS
    sets = F.broadcast(sets) if few else sets
    left = sets.select(F.col("cls").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("items").alias("y"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    return both.where(_enough(F.array_size(F.array_intersect("x", "y")), F.array_size("x"), F.array_size("y"), similarity)).select("a", "b")


def _fits(n1: Column, n2: Column, p1: Column, p2: Column, similarity: int) -> Column:
    """Whether two sets whose first common shingle stands at places p1 and p2 of their orders can share enough."""
    rest = F.least(n1 - p1, n2 - p2)
    return _enough(F.least(n1, n2), n1, n2, similarity) & _enough(rest, n1, n2, similarity)


def _band(n: Column, similarity: int, shift: float = 0.0) -> Column:
    """A set's band of sizes: sets that link are in the same or in adjacent ones."""
    return F.floor(F.log(n) / math.log(100 / similarity) + shift).cast("int") if similarity < 100 else n.cast("int")


def _dealt(posts: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """posts with `ways`: over how many tasks a shingle's postings are dealt, by the frequencies at hand; 1 for nearly all."""
    keys, counts = common
    hot = counts > HOT
    if not hot.any():
        return posts.withColumn("ways", F.lit(1))
    table = pa.table({"_top": keys[hot].astype(np.int64), "_ways": (-(-counts[hot] // HOT)).astype(np.int32)})
    table = posts.sparkSession.createDataFrame(table)
    own = posts.withColumn("_t", F.shiftrightunsigned("shingle", 64 - COUNT_BITS))
    return own.join(small(table), F.col("_t") == F.col("_top"), "left").withColumn("ways", F.coalesce("_ways", F.lit(1))).drop("_t", "_top", "_ways")


def _share(ways: str, turn: int) -> Column:
    """Which of the tasks of a shingle a group's posting goes to."""
    return F.pmod(F.xxhash64("grp", F.lit(turn)), F.col(ways)).cast("int")


def classes_of(documents: DataFrame, k: int = SHINGLE, similarity: int = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per document (doc_id, n, s1, s2); per class of equal sets (n, s1, s2, cls, root), root the least of its component, and cls its least document; links (a, b) of classes.

    Identifiers must not repeat. The links are verified ones that join the same classes as all links do: a spanning part, not all of them.
    """
    common = frequencies(documents, k)
    signed = written(prefixes(modest(documents), common, k, similarity), "prefixes")
    linked = signed.where("n > 0 AND doc_id IS NOT NULL")
    # classes with the same prefix and size are one group; only identifiers go through these shuffles, not prefixes
    keyed = linked.select("doc_id", "n", "s1", "s2", F.xxhash64("prefix").alias("g1"), F.xxhash64("n", "prefix").alias("g2"))
    classes = settle(keyed.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("cls"), F.first("g1").alias("g1"), F.first("g2").alias("g2")))
    groups = settle(classes.groupBy("g1", "g2").agg(F.min("cls").alias("grp"), F.count("*").alias("members")))
    members = settle(classes.select("cls", "n", "g1", "g2").join(small(groups.where("members > 1")), ["g1", "g2"]).select("cls", "grp", "n"))

    first = F.broadcast if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda df: df
    own = linked.withColumns({"g1": F.xxhash64("prefix"), "g2": F.xxhash64("n", "prefix")}).withColumnRenamed("doc_id", "grp")
    own = own.join(first(groups.select("grp", "g1", "g2")), ["grp", "g1", "g2"])
    posts = own.select("grp", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("place", "shingle"))
    posts = _dealt(posts, common)
    # only shingles that another group of a fitting size holds go on: sorted by size, a neighbour fits if any does; hot ones all do
    by_size = W.partitionBy("shingle", _share("ways", 0)).orderBy("n", "grp")
    fits = lambda other: F.coalesce(_enough(F.least("n", other), F.col("n"), other, similarity), F.lit(False))
    posts = posts.withColumns({"_before": F.lag("n").over(by_size), "_after": F.lead("n").over(by_size)})
    posts = posts.where((F.col("ways") > 1) | fits(F.col("_before")) | fits(F.col("_after")))
    posts = written(posts.select("shingle", "grp", "n", "place", "ways"), "postings")
    roots: DataFrame | None = None
    links: DataFrame | None = None

    def found(pairs: DataFrame) -> None:
        nonlocal roots, links
        pairs = settle(pairs)
        nodes = settle(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct())
        sets = written(_sets(documents, nodes, k), "sets")
        new = settle(_verified(pairs, sets, similarity))
        discard(sets)
        links = new if links is None else links.unionByName(new)
        forest = new if roots is None else new.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = components(forest)

    def rooted(df: DataFrame, key: str, out: str) -> DataFrame:
        if roots is None:
            return df.withColumn(out, F.col(key))
        own = small(roots.select(F.col("node").alias("_node"), F.col("root").alias("_root")))
        return df.join(own, F.col(key) == F.col("_node"), "left").withColumn(out, F.coalesce("_root", key)).drop("_node", "_root")

    for turn, most in enumerate(PARTNERS):
        own = rooted(posts, "grp", "root")
        if roots is not None:
            large = settle(roots.groupBy("root").count().where(F.col("count") >= LARGE).select(F.col("root").alias("_large")))
            held = own.join(small(large), F.col("root") == F.col("_large")).select("shingle").distinct()
            own = own.join(held, "shingle", "left_semi")
        # in an order that differs by shingle and round, each group meets the next ones of about its size
        step = _band(F.col("n"), similarity, turn / len(PARTNERS))
        ring = W.partitionBy("shingle", step, _share("ways", turn)).orderBy(F.xxhash64("grp", "shingle", F.lit(turn)))
        ahead = [F.lead(F.struct("grp", "n", "place", "root"), i + 1).over(ring) for i in range(AHEAD[turn])]
        cand = own.withColumn("_z", F.array(*ahead)).withColumn("z", F.explode("_z"))
        cand = cand.where((F.col("root") != F.col("z.root")) & _fits(F.col("n"), F.col("z.n"), F.col("place"), F.col("z.place"), similarity))
        cand = cand.groupBy(F.least("grp", "z.grp").alias("a"), F.greatest("grp", "z.grp").alias("b")).agg(F.count("*").alias("c"))
        best = W.partitionBy("b").orderBy(F.col("c").desc(), F.xxhash64("a", F.lit(turn)))
        cand = cand.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= most).select("a", "b")
        inside = rooted(members, "cls", "root").where(F.col("cls") != F.col("grp"))
        if turn == 0:
            cand = cand.union(inside.select(F.col("grp").alias("a"), F.col("cls").alias("b")))
        found(cand)

    # all that may still join two components
    own = settle(rooted(posts, "grp", "root"))
    grouped = rooted(members, "cls", "root")
    spread = grouped.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    own = own.join(small(settle(spread)), "grp", "left").withColumns({"lo": F.coalesce("lo", "root"), "hi": F.coalesce("hi", "root")})
    mixed = own.groupBy("shingle").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi")).where("_lo != _hi").select("shingle")
    own = own.join(mixed, "shingle")
    # sets that link are in the same band of sizes or in adjacent ones; a hot shingle's postings are dealt out on one side and copied on the other
    band = _band(F.col("n"), similarity)
    x = own.withColumns({"band": band, "way": _share("ways", 0)}).alias("x")
    y = own.withColumn("band", F.explode(F.array(band - 1, band, band + 1))).withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("shingle", "band", "way")]
    apart = (F.col("x.grp") < F.col("y.grp")) & (F.least("x.lo", "y.lo") != F.greatest("x.hi", "y.hi"))
    near = _fits(F.col("x.n"), F.col("y.n"), F.col("x.place"), F.col("y.place"), similarity)
    pairs = x.join(y, same[0] & same[1] & same[2] & apart & near)
    pairs = settle(pairs.select(F.col("x.grp").alias("g"), F.col("y.grp").alias("h")).distinct())
    many = grouped.select(F.col("grp").alias("_grp"), F.col("cls").alias("_cls"), F.col("root").alias("_r"))
    first = pairs.join(many, F.col("g") == F.col("_grp"), "left").select("g", "h", F.coalesce("_cls", "g").alias("a"), F.col("_r").alias("ra"))
    both = first.join(many, F.col("h") == F.col("_grp"), "left").select(F.col("a"), F.coalesce("_cls", "h").alias("b"), "ra", F.col("_r").alias("rb"))
    both = both.where((F.coalesce("ra", F.lit(-1)) != F.coalesce("rb", F.lit(-2)))).select("a", "b")
    inside = (F.col("x.grp") == F.col("y.grp")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root"))
    within = grouped.alias("x").join(grouped.alias("y"), inside).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
    left = rooted(rooted(both.union(within), "a", "ra"), "b", "rb").where("ra != rb").select("a", "b").distinct()
    found(left)
    discard(posts)
    classes = settle(rooted(classes.select("n", "s1", "s2", "cls"), "cls", "root"))
    return signed.select("doc_id", "n", "s1", "s2"), classes, links


def numbered(documents: DataFrame) -> tuple[DataFrame, bool]:
    """documents with _row, a number of its own for each row, and whether that is just doc_id. Rows are numbered, and kept in the shared folder with their
    numbers, only if an id repeats or is null."""
    odd = documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        return documents.withColumn("_row", F.col("doc_id").cast("long")), True
    return written(documents.withColumn("_row", F.monotonically_increasing_id()), "rows"), False


def near_duplicates(documents: DataFrame, k: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_shingles, component_id, class_id.

    Two documents link when 100 * shared >= similarity * (shingles in either), k words to a shingle, lower-cased in A-Z. Sets are
    compared by 64-bit hashes of their shingles: of two texts with n shingles together, some pair of different ones has equal hashes with a
    probability of about n ** 2 / 2 ** 65. Documents with equal sets are one class (class_id: its least doc_id); classes with
    the same prefix and size are one group; groups meet at shingles that both have in their prefixes, under size and
    position filters; the members of group pairs are verified. As components are asked for, pairs that earlier links
    have joined already aren't verified again, so a large group of near copies costs about one comparison a member.

    Documents without words, null texts included, have n_shingles 0 and link with nothing, their own copies included. Rows without
    a doc_id link with nothing either and have null ids. Rows that repeat an id are documents by themselves: each has its own
    text's component, whose id is the least doc_id in it. Texts of any length are read whole. An empty table gives no rows.
    """
    rows, plain = numbered(documents.select("doc_id", "text"))
    got = _rows_joined(rows.select(F.when(F.col("doc_id").isNotNull(), F.col("_row")).alias("doc_id"), "text"), k, similarity)
    if plain:
        return got
    got = got.where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "_own").join(rows.select("_row", "doc_id"), F.col("_own") == F.col("_row"))
    for name in ("component_id", "class_id"):
        least = got.groupBy(name).agg(F.min("doc_id").cast("long").alias("_least")).withColumnRenamed(name, "_name")
        got = got.join(least, F.col(name) == F.col("_name")).withColumn(name, F.col("_least")).drop("_name", "_least")
    none = F.lit(None).cast("long")
    lost = prefixes(rows.where("doc_id IS NULL"), (np.empty(0, _U), np.empty(0, np.int64)), k, similarity)
    lost = lost.select("doc_id", F.col("n").alias("n_shingles"), none.alias("component_id"), none.alias("class_id"))
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), "n_shingles", "component_id", "class_id").unionByName(lost)


def _rows_joined(rows: DataFrame, k: int, similarity: int) -> DataFrame:
    """near_duplicates of rows (doc_id, text) whose identifiers don't repeat."""
    docs, classes, _ = classes_of(rows, k, similarity)
    classes = classes.select(F.col("n").alias("_n"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), "cls", "root")
    fits = (F.col("n") == F.col("_n")) & (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & F.col("doc_id").isNotNull()
    got = docs.join(small(classes, BROADCAST_ROWS // 4), fits, "left")
    return got.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"), F.coalesce("cls", "doc_id").alias("class_id"))


def one_of_each(documents: DataFrame, k: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """documents (doc_id, text, ...) without near copies: of each component of links the row with the least doc_id (null last) stays, as do documents without words.

    Here rows count by themselves, whatever their ids: rows with equal or null ids go only if their own text is near that of a row that stays.
    """
    rows, plain = numbered(documents)
    got = _rows_joined(rows.select(F.col("_row").alias("doc_id"), "text"), k, similarity)
    if not plain:
        own = got.select("doc_id", "component_id").join(rows.select("_row", F.col("doc_id").alias("_id")), F.col("doc_id") == F.col("_row"))
        first = own.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_first"))
        got = own.join(first.withColumnRenamed("component_id", "_c"), F.col("component_id") == F.col("_c")).select("doc_id", F.col("_first._row").alias("component_id"))
    gone = got.where("component_id != doc_id").select(F.col("doc_id").alias("_gone"))
    return rows.join(small(settle(gone)), F.col("_row") == F.col("_gone"), "left_anti").drop("_row")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


#: All sets with equal ones as one class, all pairs of classes that share a shingle, and what is reachable.
OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_sort(CASE
      WHEN len(w) >= 4 THEN list_distinct(list_transform(list_zip(w, w[2:], w[3:], w[4:], true), lambda z: concat_ws(' ', z[1], z[2], z[3], z[4])))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS items
  FROM d),
c AS (
  SELECT items, min(doc_id) AS class_id, len(items) AS n, row_number() OVER (ORDER BY min(doc_id), items) AS id
  FROM s WHERE doc_id IS NOT NULL AND len(items) > 0 GROUP BY items),
p AS (SELECT id, n, unnest(items) AS shingle FROM c),
l AS (
  SELECT x.id AS a, y.id AS b
  FROM p x JOIN p y ON x.shingle = y.shingle AND x.id < y.id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY x.id, y.id, x.n, y.n HAVING 185 * count(*) >= 85 * (x.n + y.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT id, id AS other FROM c UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.other = e.a),
m AS (SELECT reach.id, min(c.class_id) AS component_id FROM reach JOIN c ON reach.other = c.id GROUP BY reach.id)
SELECT s.doc_id, len(s.items) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, coalesce(c.class_id, s.doc_id) AS class_id
FROM s LEFT JOIN c ON s.doc_id IS NOT NULL AND s.items = c.items LEFT JOIN m ON c.id = m.id
"""

"""Byte-level BPE encoding and decoding: ranked merges folded over the byte arrays of distinct words."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import Pieces
from .common import kept, modest, parts, read

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Words of more bytes are merged by a heap, one by one.
LONG = 64
#: Parts of texts that a worker remembers.
MEMORY = 120_000
_NONE = np.int64(2**31 - 1)


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Merges:
    """The literal rank map of a vocabulary, as sorted arrays: for two ids that may stand side by side, the id of both together, which is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.pieces[v] = k
        self.bits = max(1, (len(self.pieces) - 1).bit_length())
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.whole = ranks
        pairs = {}
        for word, rank in ranks.items():
            for i in range(1, len(word)):
                if (a := ranks.get(word[:i])) is not None and (b := ranks.get(word[i:])) is not None:
                    pairs[a << self.bits | b] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.ranks = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        self.dtype = np.uint16 if len(self.pieces) <= 1 << 16 else np.uint32

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a << self.bits | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (a >= 0) & (b >= 0), self.ranks[at], _NONE)

    def fold(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word: in each round, each word's adjacent pair of the least rank, the first of equals, becomes one id."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if (known := self.whole.get(w)) is not None:
                out[i] = np.array([known], np.int64)
            elif len(w) > LONG:
                out[i] = self._long(w)
            elif w:
                by_size.setdefault(-(-len(w) // 4), []).append(i)
        for n, members in by_size.items():
            for k in range(0, len(members), 20_000):
                some = members[k : k + 20_000]
                for i, ids in zip(some, self._fold([words[i] for i in some], 4 * n), strict=True):
                    out[i] = ids
        return out

    def _fold(self, words: list[bytes], width: int) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        size = np.array([len(w) for w in words])
        ids = np.where(np.arange(width) < size[:, None], self.byte[raw], -1)
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        done = np.full((len(words), width), -1, np.int64)
        live = np.arange(len(words))
        steps = np.arange(width - 1)
        while len(live):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(live)), at]
            over = best == _NONE
            if over.any():
                done[live[over], : ids.shape[1]] = ids[over]
                live, ids, ranks, at, best = live[~over], ids[~over], ranks[~over], at[~over], best[~over]
            if not len(live):
                break
            row = np.arange(len(live))
            ids[row, at] = best
            # what stands after the pair moves one place to the left; only two ranks beside the new id change
            move = steps + (steps > at[:, None])
            ids = np.concatenate((np.take_along_axis(ids, move, 1), np.full((len(live), 1), -1)), axis=1)
            ranks = np.concatenate((np.take_along_axis(ranks, np.minimum(steps + (steps >= at[:, None]), width - 2), 1)[:, :-1], np.full((len(live), 1), _NONE)), axis=1)
            left = np.maximum(at - 1, 0)
            ranks[row, at] = self.rank(ids[row, at], ids[row, at + 1])
            ranks[row, left] = np.where(at > 0, self.rank(ids[row, left], ids[row, left + 1]), ranks[row, left])
        return [x[x >= 0] for x in done]

    def _long(self, word: bytes) -> np.ndarray:
        """The same fold of a long word, with a heap of pairs by rank and place."""
        pair = {}

        def rank(a: int, b: int) -> int | None:
            if (got := pair.get((a, b), -1)) == -1:
                got = pair[a, b] = self.whole.get(self.pieces[a] + self.pieces[b])
            return got

        ids: list[int | None] = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := rank(r, ids[k])) is not None:
                    heapq.heappush(heap, (q, i, r, ids[k]))
            if (h := before[i]) >= 0 and (q := rank(ids[h], r)) is not None:
                heapq.heappush(heap, (q, h, ids[h], r))
        return np.array([x for x in ids if x is not None], np.int64)

    def encode(self, words: list[str]) -> list[bytes]:
        return [x.astype(self.dtype).tobytes() for x in self.fold([w.encode("utf-8") for w in words])]


def rank_literal(ranks: dict[bytes, int], buckets: int = 1 << 15) -> Column:
    """The ranks as one literal: a hash table of (piece, rank), as a map's look-up goes through all its keys."""
    table: list[list[dict]] = [[] for _ in range(buckets)]
    for piece, rank in ranks.items():
        table[zlib.crc32(piece) % buckets].append({"k": base64.b64encode(piece).decode(), "r": rank})
    return F.from_json(F.lit(json.dumps(table)), "array<array<struct<k:binary,r:int>>>")


def fold_in_plan(words: DataFrame, ranks: dict[bytes, int], column: str = "word") -> DataFrame:
    """Distinct words with `ids`, by higher-order functions only.

    A word's bytes are folded: each step joins the adjacent pair of the least rank, the first of equals, until no pair has one. This
    is the plain form of Merges.fold, at about ten times its cost (the README has the figures), so `encode`, which must fold millions,
    does the same fold side by side in arrays.
    """
    table, n = rank_literal(ranks), 1 << 15
    words = words.withColumn("_table", table).withColumn("_b", F.col(column).cast("binary"))
    rank = lambda piece: F.try_element_at(F.filter(F.element_at("_table", (F.crc32(piece) % n + 1).cast("int")), lambda e: e["k"] == piece), F.lit(1))["r"]
    first = F.transform(F.sequence(F.lit(1), F.octet_length("_b")), lambda i: F.substr("_b", i, F.lit(1)))

    def given(value: Column, use) -> Column:
        return F.element_at(F.transform(F.array(value), use), 1)  # the value is made once

    def step(acc: Column, _: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(acc) - 1), lambda i: rank(F.concat(F.element_at(acc, i), F.element_at(acc, i + 1))))
        join = lambda at: F.concat(F.slice(acc, F.lit(1), at - 1), F.array(F.concat(F.element_at(acc, at), F.element_at(acc, at + 1))), F.slice(acc, at + 2, F.size(acc)))
        place = lambda f: F.coalesce(F.array_position(f, F.array_min(f)), F.lit(0)).cast("int")
        return F.when(F.size(acc) < 2, acc).otherwise(given(found, lambda f: given(place(f), lambda at: F.when(at < 1, acc).otherwise(join(at)))))

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length("_b") - 1))
    folded = F.when(F.octet_length("_b") == 0, F.array().cast("array<binary>")).when(rank(F.col("_b")).isNotNull(), F.array("_b")).otherwise(F.aggregate(steps, first, step))
    return words.withColumn("_p", folded).withColumn("ids", F.transform("_p", rank)).drop("_table", "_b", "_p")


def _worker(ranks: dict[bytes, int], pattern: str) -> tuple[Merges, Pieces]:
    merges = Merges(ranks)
    return merges, Pieces(pattern, merges.encode, MEMORY)


def encode(documents: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, ids: bool = True) -> DataFrame:
    """documents (doc_id, text) -> doc_id, ids (array<int>, or its digest), decoded.

    Texts are cut by the pattern; each distinct match is folded once for each stretch of documents that a worker sees. A null
    text is an empty one: no ids. Equal rows give equal rows. Special tokens' strings are ordinary text. With ids=False: n_tokens,
    ids_sha256 and decoded_sha256 in place of the arrays. The vocabulary, 50 thousand entries, is what is broadcast.
    """
    known = modest(documents).sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, pieces = kept(("bpe", path, pattern, len(known.value)), lambda: _worker(known.value, pattern))
        decimal = [str(i) for i in range(len(merges.pieces))]
        for batch in parts(batches, "text", 2 << 20):
            rows: list[tuple] = []
            for found in pieces([x or "" for x in batch["text"].to_pylist()], merges.dtype):
                own = found.tolist()
                back = b"".join(map(merges.pieces.__getitem__, own))
                if ids:
                    rows.append((own, back))
                else:
                    rows.append((len(own), hashlib.sha256(" ".join(map(decimal.__getitem__, own)).encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
            kinds = [pa.list_(pa.int32()), pa.binary()] if ids else [pa.int64(), pa.string(), pa.string()]
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *cols], names=["doc_id", *(["ids", "decoded"] if ids else ["n_tokens", "ids_sha256", "decoded_sha256"])])

    schema = "doc_id long, ids array<int>, decoded binary" if ids else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), ids=False)

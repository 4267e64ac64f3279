"""Token ids as sorted-string tables: shards of documents by identifier, with blocks, a sparse index, a Bloom filter and a footer.

A shard is, in this order:
  magic (8 bytes); id width (u8: 2 or 4); 7 zero bytes
  blocks: entries (u16 shared, u16 own, u32 value bytes, own key bytes, value), then crc32 of the entries (u32). An entry
      shares the first `shared` bytes of its key with the one before; the first of a block shares none.
  index: for each block its last key (8 bytes), offset (u64) and size (u32)
  Bloom filter: bits, 10 a key at least
  footer: offset of the index, blocks, offset of the filter, its bits, entries, ids (6 x u64), crc32 of index and filter (u32), magic
Keys are 8 bytes, big-endian, the identifier with its sign bit turned, so that their order is the identifiers'. Numbers
are little-endian. A null identifier has the key of no bytes in an entry, stands first, and 8 zero bytes in the index.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunks import Pieces
from .common import gathered, kept, modest, read, shared_dir, small

MAGIC = b"SSTIDS01"
FOOTER = struct.Struct("<QQQQQQI8s")
ENTRY, INDEX = struct.Struct("<HHI"), struct.Struct("<8sQI")
BLOCK, SHARD, HASHES = 64 << 10, 8 << 20, 7
#: Parts that a worker remembers; the library needs most of the time.
MEMORY = 750_000
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END = 0


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _bits(keys: list[bytes], bits: int) -> np.ndarray:
    """For each key the places of its bits: two mixes of the key, added up."""
    x = np.array([struct.unpack("<Q", k.ljust(8, b"\0"))[0] for k in keys], np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        step = (x >> np.uint64(17)) | np.uint64(1)
        return (x[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


class Writer:
    def __init__(self, width: int):
        self.out, self.block, self.index, self.keys = bytearray(MAGIC + bytes([width]) + bytes(7)), bytearray(), [], []
        self.width, self.last, self.ids = width, b"", 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            shared = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        self.block += ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.ids += len(value) // self.width
        if len(self.block) >= BLOCK:
            self._end()

    def _end(self) -> None:
        if self.block:
            self.block += struct.pack("<I", zlib.crc32(self.block))
            self.index.append((self.last.ljust(8, b"\0"), len(self.out), len(self.block)))
            self.out += self.block
            self.block = bytearray()

    def finish(self) -> bytes:
        self._end()
        n_bits = max(64, -(-len(self.keys) * 10 // 64) * 64)
        bloom = np.zeros(n_bits, np.uint8)
        bloom[_bits(self.keys, n_bits).ravel().astype(np.int64)] = 1
        index, packed = b"".join(INDEX.pack(*x) for x in self.index), np.packbits(bloom).tobytes()
        at = len(self.out)
        return bytes(self.out + index + packed + FOOTER.pack(at, len(self.index), at + len(index), n_bits, len(self.keys), self.ids, zlib.crc32(index + packed), MAGIC))


class Reader:
    """A shard, by `get(offset, size)` or its bytes."""

    def __init__(self, data, size: int | None = None):
        self.get = (lambda at, n: data[at : at + n]) if size is None else data
        size = len(data) if size is None else size
        foot = FOOTER.unpack(self.get(size - FOOTER.size, FOOTER.size))
        (index_at, blocks, bloom_at, self.bits, self.entries, self.ids, crc, magic) = foot
        meta = self.get(index_at, size - FOOTER.size - index_at)
        if magic != MAGIC or zlib.crc32(meta) != crc:
            raise ValueError("not a whole shard")
        self.width = self.get(0, 16)[8]
        self.index = [INDEX.unpack_from(meta, i * INDEX.size) for i in range(blocks)]
        self.bloom = np.unpackbits(np.frombuffer(meta, np.uint8, offset=bloom_at - index_at))

    def _block(self, at: int, size: int) -> Iterator[tuple[bytes, bytes]]:
        block = self.get(at, size)
        if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError("a block is damaged")
        i, key = 0, b""
        while i < size - 4:
            shared, own, n = ENTRY.unpack_from(block, i)
            i += ENTRY.size
            key = key[:shared] + bytes(block[i : i + own])
            yield key, bytes(block[i + own : i + own + n])
            i += own + n

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for _, at, size in self.index:
            for key, value in self._block(at, size):
                yield id_of(key), np.frombuffer(value, f"<u{self.width}")

    def lookup(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of a document, the first of those with this identifier: filter, binary search in the index, then the first block whose
        last key isn't less. Only where that block ends in 8 zero bytes, which the null and the least identifier share in the index, the next follows."""
        key = key_of(doc_id)
        if not self.bloom[_bits([key], self.bits)[0].astype(np.int64)].all():
            return None
        want, low, high = key.ljust(8, b"\0"), 0, len(self.index)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < want else (low, mid)
        for last, at, size in self.index[low:]:
            for k, value in self._block(at, size):
                if k == key:
                    return np.frombuffer(value, f"<u{self.width}")
            if last > want:
                break
        return None


class Library:
    """The ids that the tokenizers library gives for whole texts, special tokens not added.

    As in the library, added tokens are cut out of a text first, the leftmost and of those the longest, and have their own ids;
    what stands between them goes through `Pieces`. If an added token takes space or words beside it into account, texts that hold one go to the
    library whole.
    """

    def __init__(self, text: str, pattern: str):
        self.pieces = _pieces(text, pattern)
        self.width = self.pieces.width
        added = [x for x in json.loads(text).get("added_tokens") or [] if x["content"]]
        self.ids = {x["content"]: x["id"] for x in added}
        self.plain = not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in added)
        names = sorted(self.ids, key=lambda x: (-len(x), x))
        self.added = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        kind = f"<u{self.width}"
        held = [i for i, x in enumerate(texts) if self.added and self.added.search(x)]
        if not held:
            return self.pieces(texts, kind)
        cut = {i: self.added.split(texts[i]) if self.plain else [] for i in held}
        between = [x for i in held for x in cut[i][::2]]
        got = iter(self.pieces([x for i, x in enumerate(texts) if i not in cut] + between, kind))
        out = [np.empty(0, kind) if i in cut else next(got) for i in range(len(texts))]
        for i, own in cut.items():
            if own:
                out[i] = np.concatenate([next(got) if k % 2 == 0 else np.array([self.ids[x]], kind) for k, x in enumerate(own)])
            else:
                out[i] = np.array(self.pieces.tokenizer.encode(texts[i], add_special_tokens=False).ids, kind)
        return out


def _pieces(text: str, pattern: str) -> Pieces:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(text)
    code = "H" if tokenizer.get_vocab_size() <= 1 << 16 else "I"

    def ids(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    # a line feed stands alone before a space and a letter, so it can part words of letters in one call
    (a, b, feed, both) = ids([" a", " bc", "\n", " a\n bc"])
    parted = len(feed) == 1 and both == a + feed + b

    def encode(words: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        plain = [i for i, x in enumerate(words) if parted and x[0] == " " and x[1:].isalpha()]
        for k in range(0, len(plain), 1_000):
            some = plain[k : k + 1_000]
            found = array(code, ids(["\n".join([words[i] for i in some])])[0])
            wide, raw = found.itemsize, found.tobytes()
            ends = np.flatnonzero(np.frombuffer(found, code) == feed[0]) * wide
            at = 0
            for i, end in zip(some, [*ends.tolist(), len(raw)], strict=True):
                out[i] = raw[at:end]
                at = end + wide
        rest = [i for i, x in enumerate(out) if not x]
        for k in range(0, len(rest), 2_000):  # the library's results are large
            for i, found in zip(rest[k : k + 2_000], ids([words[i] for i in rest[k : k + 2_000]]), strict=True):
                out[i] = array(code, found).tobytes()
        return out

    pieces = Pieces(pattern, encode, MEMORY)
    pieces.width, pieces.tokenizer = array(code).itemsize, tokenizer
    return pieces


def write(documents: DataFrame, out: str, path: str = TOKENIZER, end: int = END, shard: int = SHARD, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Writes documents (doc_id, text) as shards to the folder `out` (a URI that all executors share); gives shard, first_id, last_id, entries, ids.

    Documents are dealt out by ranges of doc_id and sorted in them, equal identifiers by text; null identifiers come first. Null and
    empty texts have the end id only. A task writes shards of about `shard` bytes under names that its partition and number give,
    each to a name of the attempt first and then renamed, so a task that runs again replaces its own shards with equal ones.
    The library gets each distinct match of its pattern; whole texts give the same ids, those with added tokens in them too.
    Texts of any length are encoded whole; rows that repeat are entries as often as they occur; an empty table gives no shard.
    """
    with open(path, encoding="utf-8") as f:
        model = modest(documents).sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, store = kept(("library", len(model.value), zlib.crc32(model.value.encode()), pattern), lambda: Library(model.value, pattern)), None
        wide = pieces.width
        task, rows, n = TaskContext.get(), [], 0
        now, first, last = Writer(wide), None, None

        def flush() -> None:
            nonlocal now, n, store
            name = f"part-{task.partitionId():06d}-{n:05d}.sst"
            if store is None:
                store = pa.fs.FileSystem.from_uri(out)
                store[0].create_dir(store[1], recursive=True)
            own = f"{store[1]}/_{name}.{task.taskAttemptId()}"
            with store[0].open_output_stream(own) as f:
                f.write(now.finish())
            store[0].move(own, f"{store[1]}/{name}")
            rows.append((name, first, last, len(now.keys), now.ids))
            n += 1
            now = Writer(wide)

        closing = np.array([end], f"<u{wide}").tobytes()
        for batch in gathered(batches, "text"):
            texts = [x or "" for x in batch["text"].to_pylist()]
            for doc_id, own in zip(batch["doc_id"].to_pylist(), pieces(texts), strict=True):
                if not now.keys:
                    first = doc_id
                now.add(key_of(doc_id), own.tobytes() + closing)
                last = doc_id
                if len(now.out) >= shard:
                    flush()
        if now.keys:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["shard", "first_id", "last_id", "entries", "ids"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    done = docs.mapInArrow(run, "shard string, first_id long, last_id long, entries long, ids long")
    manifest = f"{out}/_manifest"
    done.write.parquet(manifest)
    return documents.sparkSession.read.schema(done.schema).parquet(manifest)


def digests(spark: SparkSession, out: str, shards: DataFrame) -> DataFrame:
    """What the shards in `out` hold, read back through Spark: doc_id, start (ids in all documents before), n_tokens, ids_crc32."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                ids, at, sizes, sums, start = [], [], [], [], 0
                for doc_id, own in Reader(memoryview(data.as_buffer())).scan():
                    ids.append(doc_id)
                    at.append(start)
                    sizes.append(len(own))
                    sums.append(zlib.crc32(own.astype("<u4").tobytes()))
                    start += len(own)
                yield pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]] * len(ids), pa.string()), *(pa.array(x, pa.int64()) for x in (ids, at, sizes, sums))], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    # one row a shard, whose name sorts as its documents do
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(out).select("path", "content")
    rows = files.mapInArrow(run, "shard string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(small(starts, 100_000), "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")


def op7_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/sst-{uuid.uuid4().hex}"
    return digests(spark, out, write(read(spark, sf_dir, "documents"), out))

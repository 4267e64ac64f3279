"""Token ids, counts and files against the public libraries."""

from __future__ import annotations

import hashlib
import json
import random
import uuid
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from tidemark.llm import bpe, sstable, token_counts
from tidemark.llm.chunks import Pieces, spelt
from tidemark.llm.common import gathered, read, shared_dir
from tidemark.llm.registry import QUERIES

from .conftest import DATA, texts

RANKS = bpe.load_ranks()
MERGES = bpe.Merges(RANKS)
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
HARD = ["", " ", "  a  b", "a\n\nb \n c", "it's  they'll 　x\x1cfoo\x85bar ", "é" * 300, "ab" * 500, "日本語 テキスト", "<|endoftext|> x", "\n", "x ", " x", "1234 56,78!!??  \t\tend\n ", "don't. 'S ,,. a, b. c,. d.,", "\r\n mixed line   x", "a" * 5000]


def pieces():
    return Pieces(public_tokenizers.PATTERN, MERGES.encode)


def test_bpe_equals_the_library():
    got = pieces()(HARD, MERGES.dtype)
    assert [x.tolist() for x in got] == [TIK.encode_ordinary(x) for x in HARD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t ab,.'sÉ1"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=4))
def test_bpe_on_any_text(found):
    assert [x.tolist() for x in pieces()(found, MERGES.dtype)] == [TIK.encode_ordinary(x) for x in found]


def test_memory_is_bounded_and_forgets_safely():
    rng = random.Random(4)
    small = Pieces(public_tokenizers.PATTERN, MERGES.encode, most=60)
    for _ in range(20):
        batch = [" ".join("".join(rng.choices("abcde", k=rng.randint(1, 3))) + rng.choice(["", ",", ".", "\nx"]) for _ in range(40)) for _ in range(3)]
        assert [x.tolist() for x in small(batch, MERGES.dtype)] == [TIK.encode_ordinary(x) for x in batch]
        assert len(small.later) <= 60


def test_long_words_by_heap():
    rng = random.Random(2)
    for _ in range(30):
        w = bytes(rng.choices(b"abcdefgh 12\xc3\xa9", k=rng.randint(2, 400)))
        assert MERGES._long(w).tolist() == MERGES._fold([w], -(-len(w) // 4) * 4)[0].tolist()


def test_fold_in_plan_equals_the_library(spark):
    words = [" thntion", "idiot", " é", "日本", "a", "", " internationalization", "zzzzzzzzqqqq", " 12345", "!!??"]
    got = {r["word"]: list(r["ids"]) for r in bpe.fold_in_plan(spark.createDataFrame([(w,) for w in words], "word string"), RANKS).collect()}
    assert got == {w: TIK.encode_ordinary(w) for w in words}


def test_op6_rows(spark, odd, empty):
    for row in bpe.encode(odd, ids=False).collect():
        assert len(row["ids_sha256"]) == 64
    got = {r["doc_id"]: r for r in bpe.encode(odd).collect()}
    assert got[2]["ids"] == [] and bytes(got[8]["decoded"]).decode() == "日本語 テキスト é ñ　ü"
    assert bpe.encode(odd).count() == 10 and bpe.encode(empty).count() == 0


def test_op6_query(spark):
    want = {}
    for r in read(spark, DATA, "documents").collect():
        ids = TIK.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op6_bpe"](spark, DATA).collect()} == want


VOCAB = token_counts.vocabulary()


def unigram():
    t = Tokenizer(models.Unigram(VOCAB, 0, True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend(token_counts.MARK), normalizers.Replace(" ", token_counts.MARK)])
    return t


def test_counts_equal_the_library(spark):
    t = unigram()
    found = HARD[:-1] + ["▁ ▁▁x", "tie ties tied", "<0x0A> <s>", "a▁b"] + [r["text"] for r in read(spark, DATA, "documents").limit(80).collect()]
    assert token_counts.Counter(VOCAB)(found) == [len(t.encode(x, add_special_tokens=False).ids) for x in found]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("abethinot ▁,\né😀"), max_size=60))
def test_counts_on_any_text(text):
    assert test_counts_on_any_text.count([text]) == [len(test_counts_on_any_text.lib.encode(text, add_special_tokens=False).ids)]


test_counts_on_any_text.count, test_counts_on_any_text.lib = token_counts.Counter(VOCAB), unigram()


def test_equal_scores_take_the_piece_that_starts_first():
    tied = [("<unk>", 0.0), ("▁", -1.0), ("▁a", -2.0), ("a", -1.0), ("ab", -2.0), ("b", -1.0), ("▁ab", -3.0)]
    t = Tokenizer(models.Unigram(tied, 0, False))
    for part in ("▁ab", "▁aab", "▁aba"):
        assert token_counts.Counter(tied).viterbi(part) == token_counts.Counter(tied).short([part])[0] == len(t.encode(part).ids)


FRACTIONS = [(p, round(s * 0.377 - (i % 7) * 0.0131, 5)) for i, (p, s) in enumerate(VOCAB)]
SPACED = [*HARD[:-1], "▁ ▁▁x", "a▁b", "  two  spaces ", " x", "tie ties tied of the house", "é ü 日本"]


def test_fractional_scores_by_words_equal_the_library():
    t = Tokenizer(models.Unigram(FRACTIONS, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.MARK, prepend_scheme="always", split=True)
    assert token_counts.Counter(FRACTIONS, words=True)(SPACED) == [len(t.encode(x, add_special_tokens=False).ids) for x in SPACED]


def test_fractional_scores_of_whole_texts_equal_the_library():
    for vocab in (FRACTIONS, [*FRACTIONS, ("▁of▁the", -1.5), ("d▁", -0.25)]):
        t = Tokenizer(models.Unigram(vocab, 0, True))
        t.normalizer = normalizers.Sequence([normalizers.Prepend(token_counts.MARK), normalizers.Replace(" ", token_counts.MARK)])
        assert token_counts.Counter(vocab)(SPACED) == [len(t.encode(x, add_special_tokens=False).ids) for x in SPACED]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("abethinot ▁,\né😀"), max_size=60))
def test_fractional_counts_on_any_text(text):
    assert test_fractional_counts_on_any_text.count([text]) == [len(test_fractional_counts_on_any_text.lib.encode(text, add_special_tokens=False).ids)]


test_fractional_counts_on_any_text.count, test_fractional_counts_on_any_text.lib = token_counts.Counter(FRACTIONS, words=True), Tokenizer(models.Unigram(FRACTIONS, 0, True))
test_fractional_counts_on_any_text.lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.MARK, prepend_scheme="always", split=True)


def test_op5_query(spark):
    t = unigram()
    want = {r["doc_id"]: len(t.encode(r["text"] or "", add_special_tokens=False).ids) for r in read(spark, DATA, "documents").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in QUERIES["op5_token_counts"](spark, DATA).collect()} == want


def test_op5_long_text(spark):
    text = " ".join(f"word{i % 977} filler" for i in range(60_000))
    df = texts(spark, [(1, text, "a"), (1, text, "a"), (None, "x" * 300_000, None)])
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.count_tokens(df).collect())
    t = unigram()
    assert got == sorted((str(i), len(t.encode(x, add_special_tokens=False).ids)) for i, x in ((1, text), (1, text), (None, "x" * 300_000)))


def test_op5_rows(spark, odd, empty):
    got = token_counts.count_tokens(odd).collect()
    assert len(got) == 10 and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3)} == {0}
    assert token_counts.count_tokens(empty).count() == 0


def test_shards_find_every_key():
    rng = np.random.default_rng(3)
    keys = sorted({int(x) for x in rng.integers(-(2**40), 2**40, 3000)})
    w = sstable.Writer(2)
    w.add(b"", b"\x01\x00")
    for k in keys:
        w.add(sstable.key_of(k), np.arange(k % 50, dtype="<u2").tobytes())
    data = w.finish()
    r = sstable.Reader(data)
    assert r.entries == 3001 and len(r.index) > 1 and [i for i, _ in r.scan()] == [None, *keys]
    assert all(len(r.lookup(k)) == k % 50 for k in keys[::7]) and r.lookup(None).tolist() == [1]
    absent = [int(x) for x in rng.integers(2**41, 2**42, 2000)]
    assert all(r.lookup(k) is None for k in absent)
    hits = sum(bool(r.bloom[sstable._bits([sstable.key_of(k)], r.bits)[0].astype(int)].all()) for k in absent)
    assert hits < 60  # the filter is wrong for about one in a hundred
    by_range = sstable.Reader(lambda at, n: data[at : at + n], len(data))
    assert by_range.lookup(keys[5]).tolist() == r.lookup(keys[5]).tolist()
    with pytest.raises(ValueError):
        w.add(sstable.key_of(keys[0]), b"")
    broken = bytearray(data)
    broken[40] ^= 1
    with pytest.raises(ValueError):
        list(sstable.Reader(bytes(broken)).scan())
    with pytest.raises(ValueError):
        sstable.Reader(data[:-1])


LIB = Tokenizer.from_file(sstable.TOKENIZER)
OWN = sstable.Library(Path(sstable.TOKENIZER).read_text(encoding="utf-8"), public_tokenizers.PATTERN)
SPECIAL = [*HARD, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", " <|endoftext|>\n", "<|endoftext|", "x <|endoftext|>y z"]


def test_whole_texts_equal_the_library():
    assert [x.tolist() for x in OWN(SPECIAL)] == [LIB.encode(x, add_special_tokens=False).ids for x in SPECIAL]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", " ", "\n", "it's", " ab", "1", "<|"]), st.text(max_size=8)), max_size=8).map("".join), min_size=1, max_size=4))
def test_any_text_equals_the_library(found):
    assert [x.tolist() for x in OWN(found)] == [LIB.encode(x, add_special_tokens=False).ids for x in found]


def test_added_tokens_that_look_around_go_to_the_library():
    model = json.loads(Path(sstable.TOKENIZER).read_text(encoding="utf-8"))
    model["added_tokens"].append({"id": 50257, "content": "<sep>", "single_word": False, "lstrip": True, "rstrip": True, "normalized": False, "special": False})
    text = json.dumps(model)
    lib, found = Tokenizer.from_str(text), ["a <sep> b", "<sep>", "plain text", "x <|endoftext|> <sep>y"]
    assert [x.tolist() for x in sstable.Library(text, public_tokenizers.PATTERN)(found)] == [lib.encode(x, add_special_tokens=False).ids for x in found]


def test_null_and_least_identifiers_are_found_apart():
    w = sstable.Writer(2)
    for i in range(4):
        w.add(b"", np.full(sstable.BLOCK // 2, i, "<u2").tobytes())
    w.add(sstable.key_of(-(1 << 63)), b"\x07\x00")
    w.add(sstable.key_of(0), b"\x08\x00")
    r = sstable.Reader(w.finish())
    assert len(r.index) > 3 and r.lookup(None)[0] == 0 and r.lookup(-(1 << 63)).tolist() == [7] and r.lookup(0).tolist() == [8]


def test_gathered_batches_have_all_rows_in_order():
    rows = [(i, None if i % 7 == 0 else "é" * (i % 40)) for i in range(500)] + [(500, "x" * 9_000), (501, "")]
    batches = [pa.RecordBatch.from_pylist([{"doc_id": i, "text": x} for i, x in rows[k : k + 60]], pa.schema({"doc_id": pa.int64(), "text": pa.string()})) for k in range(0, len(rows), 60)]
    got = list(gathered([batches[0].slice(0, 0), *batches], "text", 5_000))
    assert [(x["doc_id"], x["text"]) for b in got for x in b.to_pylist()] == rows
    assert len(got) < len(batches)
    assert all(b.num_rows == 1 or sum(len((x or "").encode()) for x in b["text"].to_pylist()) <= 5_000 or b is got[-1] for b in got[:-1])
    assert list(gathered([], "text")) == [] == list(gathered([batches[0].slice(0, 0)], "text"))


def test_op7_query(spark):
    lib, want, start = LIB, {}, 0
    for r in read(spark, DATA, "documents").orderBy("doc_id").collect():
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: tuple(r)[1:4] for r in QUERIES["op7_sstable"](spark, DATA).collect()} == want


def test_op7_many_shards_and_odd_rows(spark, odd, empty):
    out = f"{shared_dir(spark)}/many-{uuid.uuid4().hex}"
    df = texts(spark, [(i, f"text number {i} " * 30, "a") for i in range(-300, 300)])
    shards = sstable.write(df, out, shard=20_000)
    got = sstable.digests(spark, out, shards).orderBy("doc_id").collect()
    assert shards.count() > 2 and [r["doc_id"] for r in got] == list(range(-300, 300))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    first = shards.orderBy("shard").first()
    data = Path(out.removeprefix("file://"), first["shard"]).read_bytes()
    assert len(sstable.Reader(data).lookup(first["last_id"])) == got[first["last_id"] + 300]["n_tokens"]
    rows = sstable.digests(spark, f"{out}2", sstable.write(odd, f"{out}2")).collect()
    assert len(rows) == 10 and min(rows, key=lambda r: r["start"])["doc_id"] is None
    assert sstable.digests(spark, f"{out}3", sstable.write(empty, f"{out}3")).count() == 0


def test_pattern_is_spelt_out():
    assert r"\s" not in spelt(public_tokenizers.PATTERN) and r"\S" not in spelt(public_tokenizers.PATTERN)

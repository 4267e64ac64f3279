"""Token counts of a unigram tokenizer by Viterbi search that carries scores and piece counts only."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import split
from .common import kept, modest, parts, read

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
#: What a character costs that no piece has, below the least score of the vocabulary.
UNKNOWN = 10.0
#: Counts of parts that a worker remembers.
MEMORY = 400_000
#: Parts of up to so many characters are searched side by side; what an array may hold bounds it.
SHORT = 48


def vocabulary(path: str = MODEL) -> list[tuple[str, float]]:
    """The pieces and scores of a public model file. They serve as a unigram vocabulary, as none of the public files is of that kind."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]


class Counter:
    """Counts pieces of texts as a unigram tokenizer with byte fallback would make them, without building them.

    At each end, an Aho-Corasick automaton gives the pieces that end there, the longest first. A later candidate wins only with a
    greater score, so of equal ones the piece that starts first wins; a character that is no piece itself may stand alone at
    the least score minus 10 and then counts as many pieces as it has bytes.

    With `words`, a text is cut before each space mark first, as a Metaspace pre-tokenizer does; a text that begins with a mark gets
    no other one. Each part is searched by itself then, for scores of any kind. Without it a text is one sequence. Where no piece has a mark behind
    another character and scores are whole numbers, whose sums are exact, its parts can still be searched apart; other vocabularies
    go through whole texts, since the rounding of a long sum may decide a tie.
    """

    def __init__(self, vocab: list[tuple[str, float]], words: bool = False):
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in vocab)
        self.words, self.apart = words, words or not (crossing or any(s != int(s) for _, s in vocab))
        self.match = ahocorasick.Automaton()
        for i, (piece, _) in enumerate(vocab):
            if piece:
                self.match.add_word(piece, i)
        self.match.make_automaton()
        self.size = np.array([len(p) for p, _ in vocab], np.int64)
        self.score = np.array([s for _, s in vocab], np.float64)
        self.unknown = float(self.score.min()) - UNKNOWN
        self.known: dict[str, int] = {}

    def found(self, part: str) -> tuple[np.ndarray, np.ndarray]:
        """Ends (exclusive) and pieces of all matches."""
        flat = np.fromiter(chain.from_iterable(self.match.iter(part)), np.int64)
        return flat[::2] + 1, flat[1::2]

    def short(self, parts: list[str]) -> list[int]:
        """The counts of parts of up to SHORT characters, searched side by side: for each end and size at most one piece matches in a part."""
        width = max(map(len, parts)) + 1
        size = np.array([len(x) for x in parts])
        starts = np.concatenate(([0], np.cumsum(size + 1)))
        ends, piece = self.found("\n".join(parts))  # no piece crosses the line feed
        row = np.searchsorted(starts, ends - 1, side="right") - 1
        at, length = ends - starts[row], self.size[piece]
        order = np.lexsort((row, -length, at))
        row, at, length, score = row[order], at[order], length[order], self.score[piece[order]]
        best, count = np.full((len(parts), width), -np.inf), np.zeros((len(parts), width), np.int64)
        best[:, 0] = 0.0
        alone = np.zeros((len(parts), width), bool)
        alone[row[length == 1], at[length == 1]] = True
        flat = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)
        bytes_of = np.ones((len(parts), width), np.int64)
        bytes_of[np.repeat(np.arange(len(parts)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + 1] = 1 + (flat >= 0x80) + (flat >= 0x800) + (flat >= 0x10000)
        step = at * 64 + (63 - length)
        cuts = np.flatnonzero(np.diff(step, prepend=-1, append=-1)).tolist()
        groups: dict[int, list[tuple[int, int]]] = {}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            groups.setdefault(int(at[a]), []).append((a, b))
        for p in range(1, width):
            for a, b in groups.get(p, ()):  # the longest first
                r, q = row[a:b], p - int(length[a])
                new = best[r, q] + score[a:b]
                won = new > best[r, p]
                r = r[won]
                best[r, p], count[r, p] = new[won], count[r, q] + 1
            r = np.flatnonzero(~alone[:, p] & (size >= p))
            new = best[r, p - 1] + self.unknown
            r, new = r[won := new > best[r, p]], new[won]
            best[r, p], count[r, p] = new, count[r, p - 1] + bytes_of[r, p]
        return count[np.arange(len(parts)), size].tolist()

    def viterbi(self, part: str) -> int:
        """The count of one part of any length."""
        n = len(part)
        ends, piece = self.found(part)
        order = np.lexsort((-self.size[piece], ends))
        each = zip(ends[order].tolist(), self.size[piece[order]].tolist(), self.score[piece[order]].tolist(), strict=True)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        now = next(each, None)
        for end in range(1, n + 1):
            top, pieces, alone = float("-inf"), 0, False
            while now and now[0] == end:
                at = end - now[1]
                alone |= now[1] == 1
                if best[at] + now[2] > top:
                    top, pieces = best[at] + now[2], count[at] + 1
                now = next(each, None)
            if not alone and best[end - 1] + self.unknown > top:
                top, pieces = best[end - 1] + self.unknown, count[end - 1] + len(part[end - 1].encode("utf-8", "replace"))
            best[end], count[end] = top, pieces
        return count[n]

    def learn(self, new: set[str]) -> None:
        brief = [x for x in new if 0 < len(x) <= SHORT]
        for i in range(0, len(brief), 20_000):
            some = sorted(brief[i : i + 20_000], key=len)
            for k in range(0, len(some), 5_000):
                own = some[k : k + 5_000]
                self.known.update(zip(own, self.short([MARK + x for x in own]), strict=True))
        for x in new:
            if x not in self.known:
                self.known[x] = self.viterbi(MARK + x)

    def __call__(self, texts: list[str | None]) -> list[int]:
        if not texts:
            return []
        if not self.apart:
            return [self.viterbi(MARK + x.replace(" ", MARK)) if x else 0 for x in texts]
        texts = [(x or "").replace(MARK, " ") for x in texts]
        index, offsets, parts = split([x.removeprefix(" ") for x in texts] if self.words else texts)
        known = self.known
        new = {x for x in parts if x not in known}
        if len(known) + len(new) > MEMORY:
            known.clear()
            new = set(parts)
        new.discard("")
        self.learn(new)
        alone = self.viterbi(MARK) if self.words else -1
        counts = np.array([known[x] if x else alone for x in parts])[index]
        if len(known) > MEMORY:
            known.clear()
        out = np.add.reduceat(counts, offsets[:-1]).tolist()
        if self.words:
            return [n if x else 0 for n, x in zip(out, texts, strict=True)]
        for i in np.flatnonzero(np.minimum.reduceat(counts, offsets[:-1]) < 0).tolist():
            # a run of marks belongs to the part after it
            out[i] = sum(self.viterbi(x) for x in re.findall(f"{MARK}+[^{MARK}]*", MARK + texts[i].replace(" ", MARK))) if texts[i] else 0
        return out


def count_tokens(documents: DataFrame, vocab: list[tuple[str, float]] | None = None, words: bool = False) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_tokens, by a unigram vocabulary of pieces and scores of any kind.

    Null and empty texts have 0. Of segmentations with equal scores the one that `Counter` names counts. Texts of any length are counted
    whole. Rows stay as they are repeated; other columns are ignored; an empty table gives no rows.
    """
    vocab = vocabulary() if vocab is None else vocab
    key = zlib.crc32(repr((vocab, words)).encode())
    known = modest(documents).sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = kept(("unigram", key), lambda: Counter(known.value, words))
        for batch in parts(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(count(batch["text"].to_pylist()), pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))

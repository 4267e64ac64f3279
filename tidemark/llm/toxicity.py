"""Toxicity scores of texts whose obfuscated words are restored first, as what a noisy channel has made of clean ones."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .chunks import split
from .common import forget, held_out, kept, modest, parts, read, settle

#: Labelled documents of each class (expected number) that weights are learned from, and features that a model may have.
SAMPLE, FEATURES = 5_000, 20_000
#: Lengths of the beginnings of longer words that are features too, as insults have endings.
STEMS = (4, 5, 6, 7)
#: What squared weights are divided by, to have about the range of the weights.
SCALE = 8.0
#: Letters that the character model knows by themselves: the most frequent ones; the others are one class.
ALPHABET = 60
#: What the channel may have made of a letter. The usual look-alikes.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h",
}
#: Log probability that the channel replaces a letter, drops a mark between letters, repeats a letter once more, keeps it, or puts a
#: space into a word of several letters a piece, which is also what the ends around a word in a stretch may cost.
SWAP, DROP, REPEAT, KEEP, SPLIT = -2.0, -0.3, -2.0, -0.1, -6.0
_L = "".join(re.escape(c) for c in LEET)
_LETTER = r"[^\W\d_]"
#: A stretch of letters, digits and look-alikes; single characters with any marks around them.
STRETCH, LIKE = re.compile(rf"[\w{_L}]{{2,}}"), re.compile(f"[{_L}]")
SINGLES = re.compile(r"(?:^|(?<=[^\W_]))[\W_]*+(?:(?<![^\W_])[^\W_](?![^\W_])[\W_]*+)+")
WORDS, TWICE, SAME = re.compile(rf"{_LETTER}+"), re.compile(r"(.)\1"), re.compile(r"(.)\1+")
#: A part that stands for one character: it once or more, with any marks around it, or a look-alike by itself.
SINGLE = re.compile(rf"[\W_]*([^\W_])\1*[\W_]*|[{_L}]")
ENDS = ".,;:!?"
#: Letters beyond which a word's feature is a hash of it.
SPELT = 40
#: Parts whose hits a worker remembers.
MEMORY = 150_000


def arrays(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(counts, np.int32), np.fromiter(counts.values(), np.float64)


class CharacterModel:
    """Trigrams of letters with word ends, from counts by key (three places to the base of ALPHABET + 3)."""

    def __init__(self, letters: str, counts: dict[int, int] | tuple[np.ndarray, np.ndarray]):
        self.base = ALPHABET + 3
        self.place = {c: i + 2 for i, c in enumerate(letters)}  # 0: a word's end, 1: any other letter
        three = np.full(self.base**3, 0.02)
        keys, n = arrays(counts) if isinstance(counts, dict) else counts
        three[keys] += n
        three = three.reshape((self.base,) * 3)
        two = three.sum(axis=0)
        one = two.sum(axis=0)
        p1 = one / one.sum()
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        self.log = np.log((three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5))
        self.flat = self.log.ravel().tolist()

    def read(self, noisy: str, ends: bool = False) -> str:
        """The likeliest letters behind a stretch of text."""
        return self.best(noisy, ends)[1]

    def best(self, noisy: str, ends: bool = False) -> tuple[float, str]:
        """The likeliest letters behind a stretch of text of any length, and their log probability: the best path through a lattice whose states are the last two letters.

        At each character the channel may have kept it, swapped a letter for a look-alike, repeated the letter before, or put a
        mark in. With `ends` a word may end behind each letter, at the price of the model's end; that reads as a space. No state is
        pruned, and paths are linked, so the cost grows with the length only. A numeral that is no look-alike is passed over.
        """
        states: dict[tuple[int, str], tuple[float, tuple]] = {(0, ""): (0.0, ())}  # by the class of the last letter but one, and the last letter
        where, log, base = self.place.get, self.flat, self.base
        for c in noisy.lower():
            options = [(c, where(c, 1), KEEP)] if c.isalpha() else [(x, where(x, 1), SWAP) for x in LEET.get(c, "")]
            if not options:
                continue  # dropped by all paths alike
            mark = not c.isalnum()
            nxt: dict[tuple[int, str], tuple[float, tuple]] = {}
            for (i, b), (score, path) in states.items():
                j = where(b, 1) if b else 0
                row = (i * base + j) * base
                for x, k, cost in options:
                    s = score + cost + log[row + k]
                    old = nxt.get((j, x))
                    if old is None or s > old[0]:
                        nxt[j, x] = (s, (path, x))
                    if x == b:
                        s = score + REPEAT
                        old = nxt.get((i, b))
                        if old is None or s > old[0]:
                            nxt[i, b] = (s, path)
                    if ends and b:
                        s = score + log[row] + cost + log[k]
                        old = nxt.get((0, x))
                        if old is None or s > old[0]:
                            nxt[0, x] = (s, (path, " " + x))
                if mark:
                    s = score + DROP
                    old = nxt.get((i, b))
                    if old is None or s > old[0]:
                        nxt[i, b] = (s, path)
            states = nxt
        last = [(score + (log[(i * base + where(b, 1)) * base] if b else 0.0), path) for (i, b), (score, path) in states.items()]
        (score, path), letters = max(last, key=lambda x: x[0]), []
        while path:
            path, x = path
            letters.append(x)
        return score, "".join(reversed(letters))

    def likelihood(self, word: str) -> float:
        """The log probability of a word."""
        c = [0, 0, *(self.place.get(x, 1) for x in word), 0]
        return sum(self.flat[(c[i] * self.base + c[i + 1]) * self.base + c[i + 2]] for i in range(len(c) - 2))


def features_of(word: str) -> list[str]:
    """A word, a very long one by its hash, and its beginnings."""
    own = word if len(word) <= SPELT else f"#{zlib.crc32(word.encode('utf-8', 'replace')):08x}{len(word)}"
    return [own, *("^" + word[:n] for n in STEMS if len(word) > n)]


def features(text: str | None) -> set[str]:
    """The features of all words of a text."""
    return {f for w in set(WORDS.findall((text or "").lower())) for f in features_of(w)}


def letter_counts(documents: DataFrame) -> tuple[str, dict[int, int]]:
    """The most frequent letters of all documents and their trigrams: counts of every text, summed in tasks and then by key."""

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(0x110000, np.int64)
        for batch in parts(batches, "text", 1 << 20):
            at = np.frombuffer("".join(x or "" for x in batch["text"].to_pylist()).lower().encode("utf-32-le", "replace"), np.uint32)
            total += np.bincount(at, minlength=0x110000)
        own = [i for i in np.flatnonzero(total).tolist() if chr(i).isalpha()]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own], pa.int64())], names=["c", "n"])

    text = modest(documents).select("text")
    best = text.mapInArrow(singles, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "c").limit(ALPHABET).collect()
    letters = "".join(chr(r["c"]) for r in best)
    base = ALPHABET + 3

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.zeros(0x110000, np.int64)
        place[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
        for i, c in enumerate(letters):
            place[ord(c)] = i + 2
        total = np.zeros(base**3, np.int64)
        for batch in parts(batches, "text", 1 << 20):
            joined = "\n".join(x or "" for x in batch["text"].to_pylist()).lower()
            c = place[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
            c = np.concatenate(([0, 0], c, [0]))
            c = c[np.concatenate(([True, True], (c[2:] != 0) | (c[1:-1] != 0)))]  # one end between words
            before = np.concatenate(([0], c[:-1]))
            first = np.concatenate(([0], before[:-1]))
            first[before == 0] = 0  # a word begins behind two ends
            keep = (c != 0) | (before != 0)
            total += np.bincount((first * base + before)[keep] * base + c[keep], minlength=base**3)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own], pa.int64())], names=["k", "n"])

    rows = text.mapInArrow(triples, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # base ** 3 at most
    return letters, {r["k"]: r["n"] for r in rows}


class Scorer:
    """Adds the weights of a text's features, squared, so that a strong one counts for more than several weak ones; a curve fitted on the labelled documents makes a score of the sum."""

    def __init__(self, weights: dict[str, float], slope: float, shift: float, model: CharacterModel | None = None):
        self.weights, self.slope, self.shift, self.model = weights, slope, shift, model
        self.known: dict[str, tuple] = {}
        # words with a weight by themselves, what they begin with, and what may follow a space that was put into them
        whole = [w for w in weights if w[0] not in "^#" and len(w) > 2]
        self.whole, self.heads = set(whole), {w[:i] for w in whole for i in range(1, len(w))}
        self.sizes = {len(w) for w in whole}
        self.inner = {w[i:j] for w in whole for i in range(1, len(w)) for j in range(i + 1, len(w) + 1)}

        # letters that any feature but a whole word begins with, and features whose doubled letters are single
        self.opening = {f[1 : 1 + min(STEMS)] for f in weights if f[0] == "^"}
        self.single = {SAME.sub(r"\1", f) for f in weights}

    def hits(self, words: Iterable[str]) -> list[tuple[str, float]]:
        """Words with a weight, the greatest among those of their features."""
        own, found = self.weights, []
        for w in words:
            if w and (w in own or len(w) > SPELT or w[: min(STEMS)] in self.opening):
                best = max(own.get(f, 0.0) for f in features_of(w))
                if best:
                    found.append((w, best))
        return found

    def _may_hit(self, word: str) -> bool:
        """Whether a word could have a weight if some of its doubled letters were single: whether it has one if all are."""
        short = SAME.sub(r"\1", word)
        return len(word) > SPELT or short in self.single or any("^" + short[:n] in self.single for n in range(1, max(STEMS) + 1))

    def score(self, evidence: float) -> float:
        x = self.slope * evidence + self.shift
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

    def _readings(self, noisy: str) -> set[str]:
        """A stretch read as one word and as several; also words with a weight in it, if ends around them cost little beside the best path."""
        best, model = self.model.best, self.model
        blob = model.read(noisy)
        out = {blob, *model.read(noisy, ends=True).split()}
        inside = {(i, i + n) for n in self.sizes for i in range(len(blob) - n + 1) if blob[i : i + n] in self.whole}
        for i, j in inside:
            if (word := blob[i:j]) not in out:
                cost = best(blob, True)[0] - best(blob[:i], True)[0] - best(blob[j:], True)[0] - model.likelihood(word) - KEEP * (j - i)
                if cost + SPLIT < 0:
                    out.add(word)
        return out

    def _part(self, part: str) -> tuple:
        """The hits of a part, a stretch without spaces, read as it is and restored."""
        core = part.rstrip(ENDS)
        if core.isalpha() and not (TWICE.search(core) and self._may_hit(core)):
            return tuple(self.hits((core,)))
        words = WORDS.findall(part)
        own = set(words)
        joined = {"".join(words)} if len(words) > 1 else set()  # marks may have been put between letters
        restored = joined | {self.model.read(w) for w in own | joined if TWICE.search(w) and self._may_hit(w)}
        for m in STRETCH.finditer(part):
            x = m.group(0)
            if LIKE.search(x) and WORDS.search(x):
                # a mark at the end may be a look-alike or just a mark
                for y in {x, x.rstrip("!|*+(<#")}:
                    restored |= self._readings(y)
        for m in SINGLES.finditer(part):
            x = m.group(0)
            if sum(c.isalnum() or c in LEET for c in x) >= 3 and sum(c.isalnum() for c in x) >= 2:
                restored |= self._readings(x)
        words += restored - own
        return tuple(self.hits(words))

    def _spaced(self, pieces: list[str]) -> str | None:
        """The word with a weight that the first pieces make together, if the model finds it likelier than the pieces as words."""
        word, apart = pieces[0], self.model.likelihood(pieces[0])
        for x in pieces[1:]:
            word, apart = word + x, apart + self.model.likelihood(x)
            if word in self.whole and self.model.likelihood(word) + SPLIT > apart:
                return word
            if word not in self.heads:
                return None
        return None

    def evidence(self, texts: list[str | None]) -> list[float]:
        """For each text the sum of its words' weights, squared and divided by SCALE; a word counts up to twice. The distinct parts of the texts are looked at once."""
        if not texts:
            return []
        index, offsets, parts = split([" ".join((x or "").lower().split()) for x in texts])
        if len(self.known) + len(parts) > MEMORY:
            self.known.clear()
        got = [self.known.get(x) for x in parts]
        for i, x in enumerate(got):
            if x is None:
                got[i] = self.known[parts[i]] = self._part(parts[i])
        found: dict[int, Counter] = {}
        weight: dict[str, float] = {}

        def add(doc: int, hits: Iterable[tuple[str, float]]) -> None:
            weight.update(hits)
            found.setdefault(doc, Counter()).update(w for w, _ in hits)

        def of(places: np.ndarray) -> list[int]:
            return (np.searchsorted(offsets, places, side="right") - 1).tolist()

        at = np.flatnonzero(np.array([bool(x) for x in got])[index])
        for doc, part in zip(of(at), index[at].tolist(), strict=True):
            add(doc, got[part])
        # single characters with spaces between them stand in parts that follow each other
        lone = np.array([SINGLE.fullmatch(x) is not None for x in parts])[index]
        edge = np.flatnonzero(np.diff(lone, prepend=False, append=False)).reshape(-1, 2)
        for a, b in edge[edge[:, 1] - edge[:, 0] >= 3].tolist():
            first, last = of(np.array([a, b - 1]))
            for doc in range(first, last + 1):
                i, j = max(a, int(offsets[doc])), min(b, int(offsets[doc + 1]))
                if j - i >= 3:
                    add(doc, self.hits(self._readings(" ".join(parts[k] for k in index[i:j].tolist()))))
        # spaces within a word
        begins = np.array([x in self.heads for x in parts])[index[:-1]]
        goes_on = np.array([x.rstrip(ENDS) in self.inner for x in parts])[index[1:]]
        at = np.flatnonzero(begins & goes_on & ~(lone[:-1] & lone[1:]))
        for i, doc in zip(at.tolist(), of(at), strict=True):
            pieces = [parts[k].rstrip(ENDS) for k in index[i : min(int(offsets[doc + 1]), i + SPELT)].tolist()]
            if word := self._spaced(pieces):
                add(doc, self.hits((word,)))
        return [sum(weight[w] ** 2 / SCALE * min(n, 2) for w, n in found[i].items()) if i in found else 0.0 for i in range(len(texts))]


def learn(train: DataFrame, letters: str, counts: dict[int, int], most: int = FEATURES) -> tuple[dict[str, float], float, float]:
    """train (_id, text, toxic) -> weights, slope and shift.

    Rows whose two least word pairs by hash are equal, as near copies' are, count once. A feature gets its log odds as a weight
    if a likelihood-ratio test finds it in toxic rows more often than chance would explain among so many features, however rare it is.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in parts(batches, "text"):
            found, keys = [], []
            for text in batch["text"].to_pylist():
                words = WORDS.findall((text or "").lower())
                found.append(sorted(features(text)))
                pairs = {xxhash.xxh64_hexdigest(f"{a} {b}") for a, b in pairwise(words)}
                keys.append("|".join(sorted(pairs or words)[:2]))
            yield pa.RecordBatch.from_arrays([batch["toxic"].cast(pa.int32()), pa.array(keys, pa.string()), pa.array(found, pa.list_(pa.string()))], names=["toxic", "key", "found"])

    rows = settle(modest(train).select("toxic", "text").mapInArrow(emit, "toxic int, key string, found array<string>").groupBy("toxic", "key").agg(F.first("found").alias("found")))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return {}, 0.0, -5.0 if n0 or not n1 else 5.0
    each = rows.select("toxic", F.explode("found").alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    each = settle(each.where(F.col("a") + F.col("b") >= 3))
    kinds = max(2, each.count())
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    log = lambda seen, due: F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)
    due1, due0 = (a + b) * n1 / (n1 + n0), (a + b) * n0 / (n1 + n0)
    ratio = 2 * (log(a, due1) + log(b, due0))
    odds = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    best = each.where((a * n0 > b * n1) & (ratio >= 1.6 * math.log(kinds))).select("f", odds.alias("w"), ratio.alias("g"))
    weights = {r["f"]: r["w"] for r in best.orderBy(F.col("g").desc(), "f").limit(most).collect()}
    packed = arrays(counts)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights, 1.0, 0.0, CharacterModel(letters, packed))
        for batch in parts(batches, "text"):
            got = [round(x, 1) for x in scorer.evidence(batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(got, pa.float64())], names=["toxic", "e"])

    seen = train.select("toxic", "text").mapInArrow(weigh, "toxic int, e double").groupBy("e").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).collect()
    e, hit, total = (np.array([float(r[k]) for r in seen]) for k in ("e", "a", "n"))
    slope, shift = 0.5, -2.0
    for _ in range(60):  # Newton's steps for a logistic curve, held back by a prior
        p = 1 / (1 + np.exp(-np.clip(slope * e + shift, -30, 30)))
        g = np.array([(e * (hit - total * p)).sum() - 0.02 * slope, (hit - total * p).sum() - 0.02 * shift])
        w = total * p * (1 - p)
        h = np.array([[(w * e * e).sum() + 0.02, (w * e).sum()], [(w * e).sum(), w.sum() + 0.02]])
        step = np.linalg.solve(h, g)
        slope, shift = slope + float(np.clip(step[0], -1, 1)), shift + float(np.clip(step[1], -2, 2))
    return weights, max(slope, 0.0), shift


def training_rows(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Labelled rows outside the held-out part, about `sample` of each label, chosen by a hash of the id: _id, text, toxic. Only the sampled labels, a bounded number, are broadcast."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, sample / max(1, n.get(1, 0)))).otherwise(min(1.0, sample / max(1, n.get(0, 0))))
    some = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_003)) < share * 1_000_003)
    docs = documents.select(F.col("doc_id").alias("_doc"), "text")
    return docs.join(F.broadcast(some), F.col("_doc") == F.col("_id")).select("_id", "text", "toxic")


class Model:
    """All that scoring needs: at most ALPHABET letters, their trigrams, and FEATURES weights."""

    def __init__(self, documents: DataFrame, labels: DataFrame, sample: int = SAMPLE):
        self.letters, self.counts = letter_counts(documents)
        self.weights, self.slope, self.shift = learn(training_rows(documents, labels, sample), self.letters, self.counts)

    def packed(self) -> dict:
        """What goes to the workers."""
        key = zlib.crc32(repr((self.letters, sorted(self.counts.items()), sorted(self.weights.items()), self.slope, self.shift)).encode())
        return {"key": key, "letters": self.letters, "counts": arrays(self.counts), "weights": self.weights, "slope": self.slope, "shift": self.shift}


def score(documents: DataFrame, model: Model) -> DataFrame:
    """documents (doc_id, text, ...) with score, 0 to 1, added.

    Null and empty texts get the score of no evidence; so does any text if no labels were given for learning. Equal texts, and
    rows that repeat, get equal scores; of readings that are equally likely, the one with the fewer letters dropped or repeated first
    in order counts. Texts of any length are read whole. An empty table gives no rows; a column named score is replaced.
    """
    known = modest(documents).sparkSession.sparkContext.broadcast(model.packed())
    docs = documents.drop("score")
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        scorer = kept(("toxicity", own["key"]), lambda: Scorer(own["weights"], own["slope"], own["shift"], CharacterModel(own["letters"], own["counts"])))
        for batch in parts(batches, "text"):
            got = [scorer.score(x) for x in scorer.evidence(batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = Model(docs, read(spark, sf_dir, "labels"))
    got = score(docs, model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

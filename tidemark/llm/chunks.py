"""Byte-level BPE ids of whole texts from ids of their distinct pieces, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The splitting pattern with white space spelt out as Unicode's White_Space property.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def spelt(pattern: str) -> str:
    return pattern.replace(r"[^\s", rf"[^{_S}").replace(r"\s", rf"[{_S}]").replace(r"(?!\S)", rf"(?![^{_S}])")


class Pieces:
    """Encodes texts through a memory of pieces.

    A single space between characters that aren't white space always starts a match of the pattern. So a text of such
    spaces only can be cut there, which Arrow does fast, and the memory has the ids of distinct parts of letters and of other
    matches. Parts of letters that it lacks go to `encode` at once, and other parts are cut into matches of the pattern;
    `encode` gets distinct matches and gives the bytes of their ids. Other texts go through the pattern as a whole. A memory
    that would pass `most` entries keeps what the texts at hand use.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[bytes]], most: int = 500_000):
        self.find, self.encode, self.most = regex.compile(spelt(pattern)).findall, encode, most
        self.words: dict[str, bytes] = {}  # by match
        self.later: dict[str, bytes] = {}  # by part of letters, without the space before it
        # whether the pattern leaves a run of letters and a mark after it as two matches
        self.plain = self.find(" ab,") == [" ab", ","] and self.find(" ab.") == [" ab", "."] and self.find(" ab") == [" ab"]

    def _matched(self, found: list[list[str]]) -> list[bytes]:
        words = self.words
        if new := {x for own in found for x in own if x not in words}:
            if len(words) + len(new) > self.most // 4:
                used = {x: words[x] for own in found for x in own if x in words}
                words.clear()
                words.update(used)
            words.update(zip(order := list(new), self.encode(order), strict=True))
        return [b"".join([words[x] for x in own]) for own in found]

    def _whole(self, text: str) -> bytes:
        found, out = self.find(text), []
        for i in range(0, len(found), self.most // 4):
            out += self._matched([found[i : i + self.most // 4]])
        return b"".join(out)

    def _known(self, parts: list[str]) -> list[bytes | None]:
        """The ids of distinct parts; None for those that white space begins or ends, and empty ones."""
        later = self.later
        got = list(map(later.get, parts))
        gaps = [i for i, x in enumerate(got) if x is None]
        lone, stems, marked, other = [], [], [], []
        for i in gaps:
            x = parts[i]
            if self.plain and x.isalpha():
                lone.append(i)
            elif self.plain and x[-1:] in (",", ".") and (stem := x[:-1]).isalpha():
                stems.append(stem)
                marked.append(i)
            elif x and not x[0].isspace() and not x[-1].isspace():
                other.append(i)
        new = [parts[i] for i in lone]
        new += {x for x in stems if x not in later}.difference(new)
        if len(later) + len(new) > self.most:
            used = {x: later[x] for x in [*parts, *stems] if x in later}
            later.clear()
            later.update(used)
        codes = self.encode([" " + x for x in new])
        later.update(zip(new, codes, strict=True))
        for i, ids in zip(lone, codes, strict=False):  # the first ones are theirs
            got[i] = ids
        ends = dict(zip(",.", self._matched([[","], ["."]]), strict=True))
        for i, x in zip(marked, stems, strict=True):
            got[i] = later[x] + ends[parts[i][-1]]
        for i, ids in zip(other, self._matched([self.find(" " + parts[i]) for i in other]), strict=True):
            got[i] = ids
        return got

    def __call__(self, texts: list[str], kind) -> list[np.ndarray]:
        """The ids of each text, as numbers of this kind."""
        if not texts:
            return []
        index, offsets, parts = split(texts)
        known = self._known(parts)
        firsts = [x.partition(" ")[0] for x in texts]
        heads = self._matched([self.find(x) for x in firsts])
        odd = np.array([x is None for x in known] + [False] * len(texts))
        index[offsets[:-1]] = np.arange(len(texts)) + len(known)  # a text's first part has no space before it
        wide = np.dtype(kind).itemsize
        each = [x or b"" for x in known] + heads
        size = np.fromiter(map(len, each), np.int64, len(each)) // wide
        ids = np.frombuffer(b"".join(each), kind)
        n = size[index]
        ends = np.cumsum(n)
        place = np.int32 if max(ends[-1], len(ids)) < 1 << 31 else np.int64
        start = (np.cumsum(size)[index] - ends).astype(place)
        places = np.repeat(start, n)
        places += np.arange(ends[-1], dtype=place)
        flat = ids[places]
        bounds = np.concatenate(([0], ends))[offsets]
        whole = np.add.reduceat(odd[index], offsets[:-1]) > 0
        for i, (x, own) in enumerate(zip(firsts, np.diff(offsets).tolist(), strict=True)):
            whole[i] |= own > 1 and (not x or x[-1].isspace())
        return [np.frombuffer(self._whole(texts[i]), kind) if whole[i] else flat[bounds[i] : bounds[i + 1]] for i in range(len(texts))]


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """All parts of the texts between single spaces, as places in the list of distinct ones, and where each text's begin; a text has one at least."""
    cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = cut.flatten().dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), cut.offsets.to_numpy().astype(np.int64), coded.dictionary.to_pylist()

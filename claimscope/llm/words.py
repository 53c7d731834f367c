"""Words and sentences of whole batches of texts as numpy arrays.

A word is a run of letters, marks and digits, compared without case.  All texts of a chunk are laid out as one
array of code points; boundaries, hashes and counts come from whole-array operations, never from a loop over words.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLANE = 1 << 16  # code points above it count as letters without case


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the first plane: is it part of a word, and the random value of its lower case."""
    chars = [chr(c) for c in range(_PLANE)]
    word = np.array([unicodedata.category(c)[0] in "LNM" for c in chars])
    lower = np.array([ord(c.lower()[0]) for c in chars], np.uint64)
    return word, mix64((lower + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=1)
def _spaces() -> np.ndarray:
    return np.array([chr(c).isspace() for c in range(_PLANE)])


@lru_cache(maxsize=1)
def _closers() -> np.ndarray:
    """Closing quotes and brackets, and the straight quotes."""
    return np.array([c in (34, 39) or unicodedata.category(chr(c)) in ("Pe", "Pf") for c in range(_PLANE)])


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def sums_of_ranges(value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range of ``value`` that depends on the order within it, not on its place."""
    up, down = _powers(len(value) + 1)
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value * up[:-1], out=total[1:])
    return mix64((total[end] - total[start]) * down[start])


class Words(NamedTuple):
    cp: np.ndarray  # code points of all texts, one line feed after each
    doc_start: np.ndarray  # position of each text in cp, and the end
    start: np.ndarray  # of each word in cp
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray  # index of each word's text


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return cp, starts


def words_of(texts: list[str]) -> Words:
    cp, doc_start = code_points(texts)
    is_word, value = _letters()
    low = cp if cp.max(initial=0) < _PLANE else np.minimum(cp, _PLANE - 1)
    inside, v = is_word[low], value[low]
    if low is not cp:
        high = cp >= _PLANE
        inside = inside | high
        v[high] = mix64(cp[high].astype(np.uint64))
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(cp) and inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(len(cp))
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(v * up, out=total[1:])
    h = mix64((total[end] - total[start]) * down[start])
    return Words(cp, doc_start, start, end, h, np.searchsorted(doc_start, start, side="right") - 1)


def first_word(w: Words) -> np.ndarray:
    """Index of the first word of each text, and the number of words."""
    return np.searchsorted(w.start, w.doc_start)


def word_grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one text; their texts; the index of their first words."""
    if len(w.hash) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = len(w.hash) - n + 1
    at = np.flatnonzero(w.doc[:count] == w.doc[n - 1 :])
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h = (h + w.hash[at + j]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return mix64(h), w.doc[at], at


def shingles(w: Words, texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word shingles of every text with repetitions: (hashes, texts).

    A text of fewer than ``n`` words has one shingle of all its words; one without words but not empty has its
    characters for a shingle; an empty text has none.
    """
    h, doc, _ = word_grams(w, n)
    first = first_word(w)
    counts = np.diff(first)
    short = np.flatnonzero((counts < n) & (counts > 0))
    extra = []
    for d in short:
        x = np.uint64(counts[d])
        for y in w.hash[first[d] : first[d + 1]]:
            x = mix64(np.array([x ^ y], np.uint64))[0]
        extra.append(x)
    bare = [d for d in np.flatnonzero(counts == 0) if texts[d]]
    for d in bare:
        s = w.cp[w.doc_start[d] : w.doc_start[d + 1] - 1].astype(np.uint64)
        up, _ = _powers(len(s))
        extra.append(mix64(np.array([np.sum(mix64(s + np.uint64(7)) * up)], np.uint64))[0])
    if extra:
        h = np.concatenate([h, np.array(extra, np.uint64)])
        doc = np.concatenate([doc, short, np.array(bare, np.int64)])
    return h, doc


class Sentences(NamedTuple):
    start: np.ndarray  # in cp
    end: np.ndarray  # with the white space that follows
    doc: np.ndarray
    words: np.ndarray  # number of words
    hash: np.ndarray  # of the words, in order


def sentences_of(w: Words) -> Sentences:
    """Sentences end after a full stop, exclamation or question mark before white space, after an ideographic full stop
    or a full-width mark whatever follows, and at line ends.  Closing quotes and brackets after a stop go with it.

    A piece without words joins the sentence before it in its text; a text without words has no sentence.
    """
    cp = w.cp
    low = np.minimum(cp, _PLANE - 1)
    space = _spaces()[low]
    wide = (cp == 0x3002) | (cp == 0xFF01) | (cp == 0xFF1F)
    stop = (cp == 46) | (cp == 33) | (cp == 63) | wide
    closer = _closers()[low]
    if (stop[:-1] & closer[1:]).any():
        before = np.maximum.accumulate(np.where(closer, 0, np.arange(len(cp))))  # what a run of closers follows
        stop, wide = stop[before], wide[before]
    cut = (cp == 10) | wide
    cut[:-1] |= stop[:-1] & space[1:]
    # a word opens a sentence if a cut lies between it and the word before it, or another text begins
    cuts = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(cut, out=cuts[1:])
    n = len(w.start)
    if not n:
        z = np.zeros(0, np.int64)
        return Sentences(z, z, z, z, np.zeros(0, np.uint64))
    opens = np.ones(n, bool)
    opens[1:] = (cuts[w.start[1:]] > cuts[w.end[:-1]]) | (w.doc[1:] != w.doc[:-1])
    head = np.flatnonzero(opens)
    doc = w.doc[head]
    counts = np.diff(np.append(head, n))
    start = w.start[head].copy()
    first = np.ones(len(head), bool)
    first[1:] = doc[1:] != doc[:-1]
    # what stands between the last cut and a sentence's first word, such as a quote mark, belongs to it
    nonspace_cut = np.maximum.accumulate(np.where(cut, np.arange(1, len(cp) + 1), 0))
    start = np.where(start > 0, nonspace_cut[np.maximum(start - 1, 0)], 0)
    start = np.maximum(start, w.doc_start[doc])
    start = np.where(first, w.doc_start[doc], start)
    end = np.empty(len(head), np.int64)
    end[:-1] = start[1:]
    last = np.append(first[1:], True)
    end[last] = w.doc_start[doc[last] + 1] - 1
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(w.hash * up, out=total[1:])
    h = mix64((total[head + counts] - total[head]) * down[head])
    return Sentences(start, end, doc, counts, h)

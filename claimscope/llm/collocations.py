"""Operator 11: phrase collocation mining with HAT-tries.

Counting.  Each task counts the phrases of its rows in a ``HatTrie``: word ids stand in for words; phrases lie in
containers, each of which covers a range of the word-id trie (several first words, or, once burst, a part of the
subtree of one first word).  A container takes phrases as they come, sorts and adds them up when it is full, and
bursts at a word boundary when it holds more than ``BURST`` phrases.  When the trie holds more than ``HELD`` phrases,
whole subtrees, the largest first, are spilled as sorted runs: rows of (lang, phrase, count), written to the shared
folder.  The runs are merged per prefix partition: a range partition of (lang, phrase), so that phrases of one prefix
lie side by side, and a sum within it.

Passes.  A phrase is counted only if its parts of the pass before are frequent: first all words, then pairs of
frequent words, triples of frequent pairs, and runs of four and five words of frequent triples.  The frequent ones
are told by a bitmap of their hashes whose size has a fixed bound; a false hit only means that a phrase is counted in
vain.  No count is approximate: what is frequent is decided on full counts, and each part of a frequent phrase is
frequent itself.

Scoring is a join of the frequent phrases with the two parts of every cut, in exact decimals.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimscope.llm.common import column_slices, lean, read_table, text_or_empty, written
from claimscope.llm.decontaminate import bitmap
from claimscope.llm.words import mix64, sums_of_ranges

LONGEST, LEAST, TOP, NO_LANG = 5, 100, 2000, "und"
BURST, HELD = 1 << 16, 1_500_000
ID_BITS = 21  # of a word id inside a packed phrase: three ids in one number
BITMAP_MIN, BITMAP_MAX = 16, 26  # as powers of two
CHUNK = 1 << 21  # bytes of text looked at in one go

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Pieces(NamedTuple):
    data: np.ndarray  # bytes of all texts, A-Z in lower case
    start: np.ndarray  # of each word
    end: np.ndarray
    text: np.ndarray  # its text
    piece: np.ndarray  # number of its piece
    hash: np.ndarray  # of language and word


def pieces_of(data: np.ndarray, edge: np.ndarray, lang: np.ndarray) -> Pieces:
    """Words of the texts ``data[edge[i]:edge[i + 1]]``, whose languages have the hashes ``lang``."""
    low = _LOWER[data]
    cut = _CUT[low]
    inside = ~(cut | _BLANK[low])
    first = np.zeros(len(low) + 1, bool)
    first[edge] = True  # a word never runs on into the next text
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text = np.searchsorted(edge, start, side="right") - 1
    cuts = np.zeros(len(low) + 1, np.int64)
    np.cumsum(cut, out=cuts[1:])
    new = np.ones(len(start), bool)
    new[1:] = (cuts[start[1:]] > cuts[end[:-1]]) | (text[1:] != text[:-1])
    h = mix64(sums_of_ranges(_VALUE[low], start, end) + lang[text])
    return Pieces(low, start, end, text, np.cumsum(new), h)


def chains(p: Pieces, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words that begin at each word, as if pieces had no ends."""
    h = np.zeros(max(len(p.hash) - n + 1, 0), np.uint64)
    for j in range(n):
        h = mix64(h + p.hash[j : j + len(h)])
    return h


class Container:
    """Phrases of one range of the trie, from ``floor`` on: packed ids (first three words; fourth and fifth), counts."""

    def __init__(self, floor: int, high: np.ndarray, low: np.ndarray, count: np.ndarray):
        self.floor, self.high, self.low, self.count = floor, high, low, count
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, high: np.ndarray, low: np.ndarray, count: np.ndarray) -> None:
        self.new.append((high, low, count))
        self.waiting += len(high)

    def settle(self) -> None:
        """Sort what waits into the container and add up equal phrases."""
        if self.new:
            parts = [(self.high, self.low, self.count), *self.new]
            self.high, self.low, self.count = added(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            self.new, self.waiting = [], 0

    def burst(self) -> tuple[Container, Container] | None:
        """Two containers cut where a first word ends, or else a second or a third one; None if all three are equal."""
        for word in range(3):
            rest = ID_BITS * (2 - word)
            prefix = self.high >> np.uint64(rest)
            ends = np.flatnonzero(prefix[1:] != prefix[:-1]) + 1
            if len(ends):
                at = ends[np.argmin(np.abs(ends - len(prefix) // 2))]
                return (
                    Container(self.floor, self.high[:at], self.low[:at], self.count[:at]),
                    Container(int(prefix[at]) << rest, self.high[at:], self.low[at:], self.count[at:]),
                )
        return None


def added(high: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases in order, equal ones added up."""
    order = np.lexsort((low, high)) if low.any() else np.argsort(high, kind="stable")
    high, low, count = high[order], low[order], count[order]
    head = np.ones(len(high), bool)
    head[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(head)
    return high[at], low[at], np.add.reduceat(count, at) if len(at) else count


class HatTrie:
    """Counts of phrases of words; see the module.  ``spill`` and ``flush`` return runs as (high, low, count)."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of the known words, in order, and their ids
        self.ids = np.zeros(0, np.int64)
        self.names: list[pa.Array] = []  # the words by id
        self.langs: list[np.ndarray] = []
        empty = np.zeros(0, np.uint64)
        self.containers = [Container(0, empty, empty, np.zeros(0, np.int64))]

    def word_ids(self, p: Pieces, lang: np.ndarray, at: np.ndarray) -> np.ndarray | None:
        """Ids (from 1) of the words at ``at``; None if there are too many different ones, and nothing is kept then."""
        distinct, first, inverse = np.unique(p.hash[at], return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        old = self.known[place] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        fresh = np.flatnonzero(~old)
        if len(self.known) + len(fresh) >= (1 << ID_BITS) - 1:
            return None
        ids = np.empty(len(distinct), np.int64)
        ids[old] = self.ids[place[old]]
        ids[fresh] = len(self.known) + 1 + np.arange(len(fresh))
        if len(fresh):
            word = at[first[fresh]]
            self.names.append(slices(p.data, p.start[word], p.end[word]))
            self.langs.append(lang[p.text[word]])
            known, all_ids = np.concatenate([self.known, distinct[fresh]]), np.concatenate([self.ids, ids[fresh]])
            order = np.argsort(known, kind="stable")
            self.known, self.ids = known[order], all_ids[order]
        return ids[inverse]

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        high, low, count = added(high, low, np.ones(len(high), np.int64))
        floors = np.array([c.floor for c in self.containers], np.uint64)
        edge = np.append(np.searchsorted(high, floors), len(high))
        for k, c in list(enumerate(self.containers)):
            if edge[k + 1] > edge[k]:
                s = slice(edge[k], edge[k + 1])
                c.add(high[s], low[s], count[s])
        todo = [c for c in self.containers if c.waiting > BURST]
        done = {}
        while todo:
            c = todo.pop()
            c.settle()
            halves = c.burst() if len(c.high) > BURST else None
            if halves:
                done[id(c)] = halves
                todo += halves
        while any(id(c) in done for c in self.containers):
            self.containers = [x for c in self.containers for x in done.get(id(c), (c,))]

    def held(self) -> int:
        return sum(len(c.high) + c.waiting for c in self.containers)

    def spill(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of the largest subtrees, so many that half of ``HELD`` is free."""
        runs = []
        for c in sorted(self.containers, key=lambda c: -(len(c.high) + c.waiting)):
            if self.held() <= HELD // 2:
                break
            runs.append(self._empty(c))
        return runs

    def flush(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return [self._empty(c) for c in self.containers]

    def _empty(self, c: Container) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c.settle()
        run = c.high, c.low, c.count
        c.high, c.low, c.count = c.high[:0], c.low[:0], c.count[:0]
        return run

    def rows(self, run: tuple[np.ndarray, np.ndarray, np.ndarray], langs: pa.Array):
        """Record batches of a run."""
        names, lang = pa.concat_arrays([pa.array([""], pa.large_string()), *self.names]), np.concatenate([[0], *self.langs])
        none, blank = (pa.scalar(x, pa.large_string()) for x in ("", " "))
        mask = np.uint64((1 << ID_BITS) - 1)
        for i in range(0, len(run[0]), 1 << 16):
            high, low, count = (x[i : i + (1 << 16)] for x in run)
            ids = [((high >> np.uint64(s)) & mask).astype(np.int64) for s in (2 * ID_BITS, ID_BITS, 0)] + [((low >> np.uint64(s)) & mask).astype(np.int64) for s in (ID_BITS, 0)]
            words = [names.take(pa.array(ids[0]))]
            for x in ids[1:]:
                if x.any():  # a shorter phrase has no such word, and no blank before it
                    word = names.take(pa.array(x))
                    words.append(pc.if_else(pa.array(x > 0), pc.binary_join_element_wise(none, word, blank), word))
            phrase = words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, none)
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[ids[0]])).cast(pa.string()), phrase.cast(pa.string()), pa.array(count)], names=["lang", "phrase", "n"])


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as strings."""
    size = end - start
    edge = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=edge[1:])
    at = np.arange(edge[-1]) + np.repeat(start - edge[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(edge), pa.py_buffer(data[at].tobytes())])


def _lang_hash(langs: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(langs).encode() + b"\0", np.uint8)
    edge = np.zeros(len(langs) + 1, np.int64)
    np.cumsum([len(x.encode()) for x in langs], out=edge[1:])
    return mix64(sums_of_ranges(_VALUE[data], edge[:-1], edge[1:]) + np.uint64(11))


def phrase_hashes(phrases: DataFrame, words: int) -> DataFrame:
    """``gram``: the hashes of ``phrases`` (lang, phrase), all of ``words`` words, as ``chains`` makes them."""

    def hashes(batches):
        for b in batches:
            langs = b.column("lang").dictionary_encode()
            lang = _lang_hash(langs.dictionary.to_pylist())[langs.indices.to_numpy()]
            for i, j, data, edge in column_slices(b.column("phrase"), CHUNK):
                p = pieces_of(data, edge, lang[i:j])
                yield pa.RecordBatch.from_arrays([pa.array(chains(p, words)[::words].view(np.int64))], names=["gram"])

    return phrases.select("lang", "phrase").mapInArrow(hashes, "gram bigint")


def counted(texts: DataFrame, lengths: tuple[int, ...], part: int, frequent: np.ndarray | None) -> DataFrame:
    """Runs (lang, phrase, n) of the phrases of ``lengths`` words in ``texts`` (lang, text) of which every run of ``part``
    words is in the bitmap ``frequent``.  With lengths (1,), also a phrase '' that counts all words."""
    shared = None if frequent is None else texts.sparkSession.sparkContext.broadcast(frequent)

    def wanted(p: Pieces, n: int, hit: np.ndarray) -> np.ndarray:
        """First words of the phrases of ``n`` words to be counted."""
        at = np.arange(max(len(p.hash) - n + 1, 0))
        at = at[p.piece[at] == p.piece[at + n - 1]]
        for j in range(n - part + 1 if len(hit) else 0):
            at = at[hit[at + j]]
        return at

    def count(batches):
        known = shared.value if shared else None
        mask = np.uint64(64 * len(known) - 1) if shared else None
        trie = HatTrie()
        names: list[str] = []  # languages met
        for b in batches:
            col = b.column("lang").dictionary_encode()
            here = col.dictionary.to_pylist()
            names += [x for x in here if x not in names]
            lang = np.array([names.index(x) for x in here], np.int64)[col.indices.to_numpy()]
            lang_hash = _lang_hash(names)
            table = pa.array(names, pa.string())
            for i, j, data, edge in column_slices(b.column("text"), CHUNK):
                own = lang[i:j]
                p = pieces_of(data, edge, lang_hash[own])
                if lengths == (1,):
                    total = np.bincount(own[p.text], minlength=len(names))
                    some = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([table.take(pa.array(some)), pa.array([""] * len(some), pa.string()), pa.array(total[some])], names=["lang", "phrase", "n"])
                hit = np.zeros(0, bool)
                if shared:
                    h = chains(p, part) & mask
                    hit = ((known[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1)).astype(bool)
                firsts = {n: wanted(p, n, hit) for n in lengths}
                used = np.zeros(len(p.hash), bool)
                for n, at in firsts.items():
                    for k in range(n):
                        used[at + k] = True
                at = np.flatnonzero(used)
                if not len(at):
                    continue
                ids = trie.word_ids(p, own, at)
                if ids is None:  # too many words for one trie: it starts anew
                    for run in trie.flush():
                        yield from trie.rows(run, table)
                    trie.clear()
                    ids = trie.word_ids(p, own, at)
                word = np.zeros(len(p.hash) + LONGEST, np.uint64)
                word[at] = ids
                for n, first in firsts.items():
                    high, low = (np.zeros(len(first), np.uint64) for _ in range(2))
                    for k in range(3):
                        high = (high << np.uint64(ID_BITS)) | (word[first + k] if k < n else np.uint64(0))
                    for k in range(3, LONGEST):
                        low = (low << np.uint64(ID_BITS)) | (word[first + k] if k < n else np.uint64(0))
                    trie.add(high, low)
                if trie.held() > HELD:
                    for run in trie.spill():
                        yield from trie.rows(run, table)
        if trie.names:
            for run in trie.flush():
                yield from trie.rows(run, pa.array(names, pa.string()))

    return texts.mapInArrow(lean(count), "lang string, phrase string, n bigint")


def merged(runs: DataFrame) -> DataFrame:
    """Full counts of the phrases in the written ``runs``."""
    return runs.repartitionByRange("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``lang``, ``words``, ``phrase`` and ``n`` of every phrase of up to ``longest`` (3 to 5) words that occurs at
    least ``least`` times, and of the phrase '' with the number of all words (``words`` 0)."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), text_or_empty(text_col).alias("text"))
    steps = [((1,), 0), ((2,), 1), ((3,), 2), (tuple(range(4, longest + 1)), 3)]
    found, frequent = [], None
    for lengths, part in steps:
        if not lengths:
            break
        runs = written(counted(texts, lengths, part, frequent), "runs")
        full = merged(runs).where((F.col("n") >= least) | (F.col("phrase") == ""))
        full = written(full.select("lang", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))).alias("words"), "phrase", "n"), "phrases")
        found.append(full)
        kept = full.where("words > 0")
        size = kept.count()
        if not size:
            break
        if lengths[0] < 4:
            bits = min(BITMAP_MAX, max(BITMAP_MIN, math.ceil(math.log2(16 * size))))
            frequent = bitmap(phrase_hashes(kept, lengths[0]), bits)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of the ``top`` phrases of each language.

    Null texts are empty, a null language is 'und'; repeated rows count as often as they stand; other columns are not
    looked at.  An empty table, or one without a frequent phrase, gives an empty result.  Of equal phrases there is one
    a language, so ranks have no ties.  A word's identity inside a trie is a 64-bit hash; runs carry the words
    themselves, and what is added up in the merge are equal strings.
    """
    full = written(frequent_phrases(docs, lang_col, text_col, least, longest), "frequent")
    total = full.where("words = 0").select("lang", F.col("n").alias("all"))
    cand = full.where("words >= 2").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"), "words")
    # drop those inside a longer candidate that is as frequent
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> concat_ws(' ', slice(w, i, m)))))")
    inside = cand.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
    covering = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = cand.join(covering, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")
    cut = F.explode(F.expr("transform(sequence(1, words - 1), k -> struct(k as k, concat_ws(' ', slice(w, 1, k)) as first, concat_ws(' ', slice(w, k + 1, words - k)) as rest))"))
    cuts = written(kept.select("lang", "phrase", "a", cut.alias("c")).select("lang", "phrase", "a", "c.k", "c.first", "c.rest"), "cuts")
    counts = full.where("words > 0")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.join(total, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.withColumns({"top": (F.lit(1000) * F.col("a")).cast("decimal(19,0)") * big("all"), "bottom": big("l") * big("r")})
    scored = scored.withColumn("score", F.expr("top div bottom"))
    best = scored.groupBy("lang", "phrase", "a", F.col("all").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    return collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


OP11_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces) WHERE len(w) > 0
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM words, (SELECT unnest(range(1, {LONGEST + 1})) AS m) WHERE len(w) >= m
), counts AS (
  SELECT lang, m, phrase, count(*) AS n, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, m, phrase HAVING count(*) >= {LEAST}
), covering AS (
  SELECT lang, phrase, max(n) AS longer FROM (
    SELECT lang, n, unnest(flatten(list_transform(range(2, m), lambda k: list_transform(range(1, m - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS phrase
    FROM counts WHERE m > 2) GROUP BY lang, phrase
), cuts AS (
  SELECT c.lang, c.phrase, c.n AS a, unnest(range(1, m)) AS k, w FROM counts c LEFT JOIN covering v ON v.lang = c.lang AND v.phrase = c.phrase
  WHERE m >= 2 AND (longer IS NULL OR longer < c.n)
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, f.n AS l, s.n AS r, total.n AS n, (1000::HUGEINT * a * total.n) // (f.n::HUGEINT * s.n) AS score
  FROM cuts JOIN counts f ON f.lang = cuts.lang AND f.phrase = array_to_string(cuts.w[1:k], ' ')
  JOIN counts s ON s.lang = cuts.lang AND s.phrase = array_to_string(cuts.w[k + 1:], ' ') JOIN total ON total.lang = cuts.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l,
  r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {TOP}
"""

"""Operator 10: packing along a space-filling curve.

Each document is encoded once by a public tokenizer.  Its vector, the mean of fixed random directions of its token
ids (a hashed bag of tokens projected to ``DIMS`` dimensions), is quantised and turned into a Hilbert key.  Documents
are range-sorted by that key, so that neighbours on the curve, which are alike, follow each other, and the tokens of
each range are cut into sequences of ``length`` tokens, documents being split where a sequence is full.  What a
range leaves over (fewer than ``length`` tokens) is cut at powers of two, so no sequence needs padding.

Scale: the ids travel once, two bytes each, in one range shuffle whose sort key ends with the document's hash, so a
large group of copies is spread over ranges.  A task streams through its range and holds one sequence at a time.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.common import CACHES, TEXT_HASH, column_chunks, keyed_texts, lean, written

LENGTH, END_ID = 4096, 2
DIMS, BITS = 4, 12
_SEPARATOR = "\x01"  # a word that no other text yields once texts that hold it are encoded by themselves
_PART = 512  # pieces encoded in one call; longer strings fall out of the processor's cache
_KNOWN_WORDS = 600_000  # pieces in a worker's memory; beyond, it starts anew and keeps those still in use (some 180 MB)
#: Letters whose lower case is one letter and that no normal form changes: Latin up to U+017F, less one whose lower
#: case holds a mark.
_LATIN = re.compile("[A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch
#: How byte-level tokenizers write a byte: as its Latin-1 sign if that is visible, or else as the next sign from 256 on.
_HIDDEN = [*range(33), *range(127, 161), 173]
_BYTE_SIGNS = {b: 256 + k for k, b in enumerate(_HIDDEN)}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts, remembering the ids of pieces between blanks.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its pieces between
    blanks and line feeds in order.  Pieces not met before are encoded together in one call, with a separator.
    """

    def __init__(self, path: str, known_words: int = _KNOWN_WORDS):
        from tokenizers import Tokenizer

        self.known_words = known_words
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids must fit into 16 bits")
        self.ends_word = np.zeros(1 << 16, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.separator = self._ids(_SEPARATOR)
        self.model = self.tokenizer.model
        self.two_bytes = [i.to_bytes(2, "little") for i in range(max(vocabulary.values()) + 1)]
        self.stops = {c: np.array(self._ids(c), "<u2").tobytes() for c in ".,"}
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}  # what was known until the memory last started anew
        self.cores: dict[str, bytes] = {}  # runs of Latin letters in lower case, at most as many as pieces

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, words: list[str]) -> None:
        """A stop or comma after a letter or digit is a word of the tokenizer by itself, and its words have no case, so
        ``The``, ``the,`` and ``the.`` are looked up as ``the``.  A run of Latin letters is one word for the
        tokenizer's model; other runs of letters end with an id that ends a word; the rest is set apart by a separator."""
        one, more, cores = [], [], self.cores
        known, tokenize, two_bytes, stops = self.known, self.model.tokenize, self.two_bytes, self.stops
        for w in words:
            core, stop, letters = w, b"", w.isalpha()
            if not letters and w[-1] in stops and w[-2:-1].isalnum():
                core, stop = w[:-1], stops[w[-1]]
                letters = core.isalpha()
            if letters and (core.isascii() or _LATIN(core)):
                core = core.lower()
                ids = cores.get(core)
                if ids is None:
                    seen = core if core.isascii() else core.encode().decode("latin-1").translate(_BYTE_SIGNS)
                    ids = cores[core] = b"".join([two_bytes[x.id] for x in tokenize(seen)])
                known[w] = ids + stop
            elif w.isalpha() and "\u0130" not in w:  # its lower case holds a mark
                one.append(w)
            elif _SEPARATOR not in w:
                more.append(w)
        for part in (one[i : i + _PART] for i in range(0, len(one), _PART)):
            ids = np.array(self._ids(" ".join(part)), "<u2")
            ends = (2 * np.flatnonzero(self.ends_word[ids]) + 2).tolist()
            self._cut(part, ids, [0, *ends[:-1]], ends)
        for part in (more[i : i + _PART] for i in range(0, len(more), _PART)):
            ids = np.array(self._ids(f" {_SEPARATOR} ".join(part)), "<u2")
            cut = (2 * np.flatnonzero(ids == self.separator[0])).tolist() if len(self.separator) == 1 else []
            self._cut(part, ids, [0, *[c + 2 for c in cut]], [*cut, 2 * len(ids)])
        for w in words:
            if w not in known:
                known[w] = np.array(self._ids(w), "<u2").tobytes()

    def _cut(self, words: list[str], ids: np.ndarray, starts: list[int], ends: list[int]) -> None:
        """Remember the words' ids, if there are as many stretches of ids as words."""
        if len(words) == len(starts) == len(ends):
            data = ids.tobytes()
            self.known.update(zip(words, map(data.__getitem__, map(slice, starts, ends)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 16-bit ids of each text."""
        split = [t.replace("\n", " ").split(" ") for t in texts]  # other white space stays inside a piece
        pieces = set().union(*split)
        new = pieces.difference(self.known)
        if new:
            if len(self.known) + len(new) > self.known_words:
                self.before, self.known, self.cores, new = self.known, {"": b""}, {}, pieces - {""}
            if self.before:
                again = [w for w in new if w in self.before]
                self.known.update(zip(again, map(self.before.__getitem__, again), strict=True))
                new.difference_update(again)
            self._learn(list(new))
        ids = self.known.__getitem__
        return [b"".join(map(ids, s)) for s in split]


@lru_cache(maxsize=4)
def _encoder(path: str, known_words: int) -> WordEncoder:
    return WordEncoder(path, known_words)


CACHES.append(_encoder.cache_clear)  # only encoding needs it


@lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    return np.random.default_rng(10).standard_normal((1 << 16, DIMS)).astype(np.float32)


def document_vectors(ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Mean direction of each document's ids; zero for a document without any."""
    n = np.diff(edges)
    total = np.zeros((len(n), DIMS))
    some = np.flatnonzero(n)
    if len(some):
        total[some] = np.add.reduceat(_directions()[ids], edges[some], axis=0)
    return total / np.maximum(n, 1)[:, None]


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points (n x dims, each below 2^bits), by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    dims, one = len(x), np.int64(1)
    q = one << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = one << (bits - 1)
    while q > 1:
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def encoded(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, known_words: int = _KNOWN_WORDS, lasting: bool = True) -> DataFrame:
    """``__cs_id``, ``__cs_key``, ``__cs_th``, ``curve`` (Hilbert key), ``n`` (tokens with the end) and ``ids``."""
    keyed = keyed_texts(docs, id_col, text_col)
    out = T.StructType([f for f in keyed.schema if f.name != "__cs_text"] + [T.StructField("curve", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    end = np.array([end_id], "<u2").tobytes()

    def encode(batches):
        encoder = _encoder(path, known_words)
        for b in batches:
            kept = [c for c in b.schema.names if c != "__cs_text"]
            for i, j, texts in column_chunks(b.column("__cs_text")):
                rows = encoder.encode(texts)
                edges = np.zeros(j - i + 1, np.int64)
                np.cumsum([len(x) // 2 for x in rows], out=edges[1:])
                vectors = document_vectors(np.frombuffer(b"".join(rows), "<u2"), edges)
                points = np.clip((vectors + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(hilbert_keys(points)), pa.array(np.diff(edges) + 1), pa.array([x + end for x in rows], pa.binary())], names=[*kept, "curve", "n", "ids"])

    return keyed.mapInArrow(encode if lasting else lean(encode), out)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = True, known_words: int = _KNOWN_WORDS, lasting: bool = True) -> DataFrame:
    """One row for each piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``
    and, unless ``with_ids`` is false, ``ids`` (16-bit little-endian).

    A null or empty text is the end id alone.  Repeated rows are packed as often as they occur.  An empty table
    gives an empty result.  A worker remembers the ids of about ``known_words`` pieces of text and, if ``lasting``,
    keeps them for its next task; fewer, and no longer, cost time but leave memory to others.
    """
    src = written(encoded(docs, id_col, text_col, path or tokenizer_path(), end_id, known_words, lasting), "encoded")
    ordered = src.repartitionByRange("curve", "__cs_key", TEXT_HASH).sortWithinPartitions("curve", "__cs_key", TEXT_HASH)
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = T.StructType([T.StructField(id_col, src.schema["__cs_id"].dataType), *[T.StructField(c, T.LongType()) for c in longs]] + ([T.StructField("ids", T.BinaryType())] if with_ids else []))
    ordered = ordered.select("__cs_id", "n", "ids")

    def cut(batches):
        base = TaskContext.get().partitionId() << 40
        sequence, filled = 0, []  # the pieces of the sequence that is being filled
        room = length

        def rows(pieces, first, limits):
            """Pieces laid out one after the other into sequences of the given sizes."""
            got, k, offset = [], first, 0
            for doc, start, ids, total in pieces:
                at = 0
                while at < len(ids):
                    size = min((len(ids) - at), (limits[k - first] - offset) * 2)
                    part = ids[at : at + size]
                    got.append((doc, start + at // 2, part, total, base + k, offset))
                    at, offset = at + size, offset + size // 2
                    if offset == limits[k - first]:
                        k, offset = k + 1, 0
            return got

        def batch(got, id_type):
            crc = [zlib.crc32(np.frombuffer(x[2], "<u2").astype("<u4").tobytes()) for x in got]
            cols = [pa.array([x[0] for x in got], id_type), pa.array([x[1] for x in got], pa.int64()), pa.array([len(x[2]) // 2 for x in got], pa.int64()), pa.array(crc, pa.int64()), pa.array([x[3] for x in got], pa.int64()), pa.array([x[4] for x in got], pa.int64()), pa.array([x[5] for x in got], pa.int64())]
            return pa.RecordBatch.from_arrays(cols + ([pa.array([x[2] for x in got], pa.binary())] if with_ids else []), names=[id_col, *longs] + (["ids"] if with_ids else []))

        id_type = pa.null()
        for b in batches:
            id_type, got = b.schema.field("__cs_id").type, []
            for doc, total, ids in zip(b.column("__cs_id").to_pylist(), b.column("n").to_pylist(), b.column("ids").to_pylist(), strict=True):
                at = 0
                while at < total:
                    size = min(room, total - at)
                    filled.append((doc, at, ids[2 * at : 2 * (at + size)], total))
                    at, room = at + size, room - size
                    if not room:
                        got += rows(filled, sequence, [length])
                        sequence, filled, room = sequence + 1, [], length
            if got:
                yield batch(got, id_type)
        rest = length - room
        if rest:
            sizes = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
            yield batch(rows(filled, sequence, sizes), id_type)

    return ordered.mapInArrow(lean(cut), out)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, with_ids=False)

"""Operator 5: language identification by multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams (1 to ``max_n`` letters, with word edges) of labelled documents; the smoothed
log probabilities form a matrix of 2^``bits`` bins by languages.  That matrix, whose size does not depend on the
corpus, is broadcast, and each task scores its texts batch by batch in numpy: every n-gram of the whole text looks
up its row, and rows are summed by document.

Training takes whole texts of at most about ``max_docs`` documents a language, chosen by a hash of their id; this
bound is the only sampling, prediction reads everything.  There is no shuffle but the sum of the bins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.common import batch_of, column_chunks, lean, text_or_empty
from claimscope.llm.words import _PLANE, _letters, code_points, mix64

BITS, MAX_N, MAX_DOCS, ALPHA = 16, 3, 4000, 0.5
UNKNOWN = "und"
CHUNK = 1 << 18  # bytes of text scored at once


@dataclass(frozen=True)
class Model:
    langs: list[str]  # in order; ties go to the first
    log_prob: np.ndarray  # bins x languages
    log_prior: np.ndarray
    max_n: int


def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(_PLANE)])


def _letters_of(cp: np.ndarray) -> np.ndarray:
    """Is each code point a letter?  Those above the first plane are looked up once for each distinct one."""
    letter = _LETTER[0][np.minimum(cp, _PLANE - 1)]
    high = np.flatnonzero(cp >= _PLANE)
    if len(high):
        distinct, place = np.unique(cp[high], return_inverse=True)
        letter[high] = np.array([chr(c).isalpha() for c in distinct])[place]
    return letter


_LETTER: list[np.ndarray] = []


def grams(texts: list[str], bits: int, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, text) of every n-gram, sorted by text.  Whatever is no letter counts as one word edge."""
    if not _LETTER:
        _LETTER.append(_letter_table())
    cp, doc_start = code_points(texts)
    low = np.minimum(cp, _PLANE - 1)
    letter = _letters_of(cp)
    value = np.where(letter, _letters()[1][low] ^ (cp >= _PLANE) * cp.astype(np.uint64), np.uint64(0))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of edges only the first stays
    at = np.flatnonzero(keep)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.concatenate([[np.uint64(0)], value[at]])
    doc = np.searchsorted(doc_start, at, side="right") - 1
    doc = np.concatenate([doc[:1], doc])
    is_letter = s != 0
    bins, docs = [], []
    h = s
    for n in range(1, max_n + 1):
        if n > 1:
            h = (h[:-1] * np.uint64(0x2545F4914F6CDD1D) + s[n - 1 :]) if len(h) > 1 else h[:0]
        m = len(h)
        if n == 1:
            ok = is_letter.copy()
        else:  # an edge may stand first or last, with a letter beside it
            ok = is_letter[:m] | is_letter[n - 1 :]
            for j in range(1, n - 1):
                ok &= is_letter[j : j + m]
        g = mix64(h[ok] + np.uint64(n * 0x51ED27)) >> np.uint64(64 - bits)
        bins.append(g.astype(np.int64))
        docs.append(doc[n - 1 :][ok])
    b, d = np.concatenate(bins), np.concatenate(docs)
    order = np.argsort(d, kind="stable")
    return b[order], d[order]


def held_out(id_col: str) -> Column:
    """Documents that training must not see: CRC-32 of the id as text leaves 1 modulo 3 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bits: int = BITS, max_n: int = MAX_N, max_docs: int = MAX_DOCS, alpha: float = ALPHA) -> Model:
    """Fit on documents with id, text and language that are not held out.  Without any, the model has no language."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    usable = usable.select(F.col(id_col).alias("__cs_id"), F.col(text_col).alias("__cs_text"), F.col(lang_col).cast("string").alias("__cs_lang"))
    sizes = {r["__cs_lang"]: r["count"] for r in usable.groupBy("__cs_lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((1 << bits, 0)), np.zeros(0), max_n)
    langs = sorted(sizes)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, max_docs / sizes[k])))])
    draw = F.pmod(F.xxhash64(F.col("__cs_id"), F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = usable.where(draw < share[F.col("__cs_lang")]).select("__cs_text", "__cs_lang")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            own = b.column("__cs_lang").to_pylist()
            for i, j, texts in column_chunks(b.column("__cs_text"), CHUNK):
                g, d = grams(texts, bits, max_n)
                for lang in sorted(set(own[i:j])):
                    mine = np.array([x == lang for x in own[i:j]])
                    total[lang] = total.get(lang, 0) + np.bincount(g[mine[d]], minlength=1 << bits)
        schema = pa.schema([("lang", pa.string()), ("bin", pa.int64()), ("n", pa.int64())])
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield batch_of(schema, lang=[lang] * len(at), bin=at, n=n[at])

    counts = sample.mapInArrow(lean(count), "lang string, bin bigint, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    matrix = np.full((1 << bits, len(langs)), alpha)
    got = counts.toPandas()  # at most 2^bits rows a language
    place = {k: i for i, k in enumerate(langs)}
    np.add.at(matrix, (got["bin"].to_numpy(np.int64), got["lang"].map(place).to_numpy(np.int64)), got["n"].to_numpy(float))
    prior = np.array([sizes[k] for k in langs], float)
    return Model(langs, np.log(matrix / matrix.sum(axis=0)), np.log(prior / prior.sum()), max_n)


def score_texts(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """Most probable language of each text and its probability.

    The n-grams of a text depend on each other, so the summed log likelihood is divided by the square root of
    their number before it is turned into probabilities; the order of the languages is that of the sums.
    """
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    g, d = grams(texts, int(len(model.log_prob)).bit_length() - 1, model.max_n)
    if not model.langs or not len(g):
        return langs, scores
    head = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    n = np.diff(np.append(head, len(d)))
    total = np.stack([np.add.reduceat(model.log_prob[:, k][g], head) for k in range(len(model.langs))], axis=1)
    total = (total + model.log_prior) / np.sqrt(n)[:, None]
    best = total.argmax(axis=1)
    p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    for row, k, x in zip(d[head], best, p, strict=True):
        langs[row], scores[row] = model.langs[k], x
    return langs, scores


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (replaced if there are such columns).

    A null, empty or letterless text, and any text if the model has no language, gets ``und`` with score 0.
    Only the text column is used.
    """
    docs = docs.drop("lang_pred", "score")
    log_prob = [np.ascontiguousarray(model.log_prob[:, k]) for k in range(len(model.langs))]
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, log_prob, model.log_prior, model.max_n, model.log_prob.shape))
    out = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def score(batches):
        langs, columns, prior, max_n, shape = shared.value
        own = Model(langs, np.stack(columns, axis=1) if columns else np.zeros(shape), prior, max_n)
        own = Model(langs, np.asfortranarray(own.log_prob), prior, max_n)
        for b in batches:
            for i, j, texts in column_chunks(b.column(text_col), CHUNK):
                got, p = score_texts(texts, own)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string()), pa.array(p, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(lean(score), out)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.select("doc_id", "text", "lang"))
    scored = predict(docs.select("doc_id", text_or_empty().alias("text")), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


#: A document whose best language is less probable than this is rejected by the pipeline.
MIN_SCORE = 0.5


def keep_known_language(docs: DataFrame, labelled: DataFrame | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """Rows of ``docs`` in a known language: those with ``und`` or a score under ``min_score`` go."""
    model = train(docs if labelled is None else labelled)
    alias = {c: f"__cs_c{i}" for i, c in enumerate(docs.columns)}  # no input column can clash with a result's
    moved = docs.select(*[F.col(c).alias(a) for c, a in alias.items()])
    scored = predict(moved, model, alias["text"])
    kept = scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return kept.select(*[F.col(a).alias(c) for c, a in alias.items()])

"""Operator 11: the trie against a dictionary, the query against brute force and DuckDB."""

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from claimscope.llm import collocations as C


def brute(rows, least, top):
    """The contract, written down on Python dictionaries."""
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", text or ""
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for c in ".,;:!?\n\v\f\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            total[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    counts[lang, tuple(w[i : i + m])] += 1
    good = {k: v for k, v in counts.items() if v >= least}
    covered = Counter()
    for (lang, w), n in good.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                covered[lang, w[i : i + m]] = max(covered[lang, w[i : i + m]], n)
    out = {}
    for (lang, w), a in good.items():
        if len(w) < 2 or covered[lang, w] >= a:
            continue
        cuts = [(1000 * a * total[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]], total[lang]))
    return {(lang, r + 1, p.decode(), -a, x, y, n, -s) for lang, v in out.items() for r, (s, a, p, x, y, n) in enumerate(sorted(v)[:top])}


def rows_of(df):
    return {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["a", "B", "the", "été", "x" * 40, "日本", "Çа", "don't", " ", "\U0001f600"]
    made = []
    for k in range(60):
        t = "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\x0b", "!"]) for _ in range(rng.randrange(0, 60)))
        made.append((rng.choice(["en", "de", None]), t))
    return made + [("en", None), ("en", ""), (None, " . "), ("de", "a b c d e f " * 40), ("en", "a a a a a a a a"), ("en", "same same"), ("en", "same same")]


@pytest.mark.parametrize(("least", "top"), [(2, 2000), (5, 4)])
def test_equals_brute_force(spark, texts, least, top):
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in texts], "lang string, text string, n int, phrase string").repartition(3)
    assert rows_of(C.collocations(df, least=least, top=top)) == brute(texts, least, top)


def test_empty_tables(spark):
    for rows in ([], [(None, None)], [("en", "once")]):
        assert C.collocations(spark.createDataFrame(rows, "lang string, text string")).collect() == []


def test_very_long_text(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(600_000))
    rows = [("en", text), ("en", "alpha beta")]
    assert rows_of(C.collocations(spark.createDataFrame(rows, "lang string, text string"))) == brute(rows, 100, 2000)


def test_exact_beyond_64_bits(spark, monkeypatch):
    # 1000 * a * n over l * r with counts far beyond what a small table can hold
    full = [("en", 0, "", 10**13), ("en", 1, "p", 10**12), ("en", 1, "q", 10**12 - 1), ("en", 2, "p q", 10**11 + 7)]
    monkeypatch.setattr(C, "frequent_phrases", lambda *a: spark.createDataFrame(full, "lang string, words int, phrase string, n long"))
    (row,) = C.collocations(spark.createDataFrame([], "lang string, text string")).collect()
    assert row["score"] == 1000 * (10**11 + 7) * 10**13 // (10**12 * (10**12 - 1))


def test_trie_bursts_and_spills(monkeypatch):
    monkeypatch.setattr(C, "BURST", 16)
    monkeypatch.setattr(C, "HELD", 300)
    rng = np.random.default_rng(5)
    trie, runs, want = C.HatTrie(), [], Counter()
    for _ in range(40):
        ids = rng.zipf(1.6, (200, 5)).clip(1, 50).astype(np.uint64)
        ids[:, 2:][rng.random(200) < 0.5] = 0
        high = (ids[:, 0] << np.uint64(42)) | (ids[:, 1] << np.uint64(21)) | ids[:, 2]
        low = (ids[:, 3] << np.uint64(21)) | ids[:, 4]
        want.update(zip(high.tolist(), low.tolist(), strict=True))
        trie.add(high, low)
        if trie.held() > C.HELD:
            runs += trie.spill()
            assert trie.held() <= C.HELD // 2
    assert len(trie.containers) > 10 and len(runs) > 1
    runs += trie.flush()
    got = Counter()
    for high, low, count in runs:
        keys = list(zip(high.tolist(), low.tolist(), strict=True))
        assert keys == sorted(set(keys))  # a sorted run
        for k, n in zip(keys, count.tolist(), strict=True):
            got[k] += n
    assert got == want


def test_pieces_do_not_cross_texts():
    col = pa.array(["ab", "cd e", "", "f.g h"])
    (slice_,) = C.column_slices(col, 1 << 20)
    p = C.pieces_of(slice_[2], slice_[3], np.zeros(4, np.uint64))
    words = [bytes(p.data[a:b]).decode() for a, b in zip(p.start, p.end, strict=True)]
    assert words == ["ab", "cd", "e", "f", "g", "h"]
    assert p.text.tolist() == [0, 1, 1, 3, 3, 3]
    assert p.piece.tolist() == [1, 2, 2, 3, 4, 4]
    assert [x for i, j, d, e in C.column_slices(col.slice(1), 1) for x in (i, j)] == [0, 1, 1, 2, 2, 3]


def test_query_equals_duckdb(spark, sf_small):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_small}/documents.parquet'")
    want = con.sql(C.OP11_SQL).fetchall()
    got = [tuple(r) for r in C.op11_collocations(spark, sf_small).collect()]
    assert sorted(got) == sorted(want) and len(got) > 20

"""Near-duplicate groups and repeated spans against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimscope.llm.components import components
from claimscope.llm.near_dedup import bag_signatures, keep_one, multisets, near_duplicate_groups, overlap
from claimscope.llm.substring_dedup import merged, remove_repeated_spans, spans_of


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(rng, text, k):
    w = text.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = words(rng, 1)
    return " ".join(w)


def brute_groups(texts):
    sets = [multisets([t])[1:] for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if overlap(sets[a], sets[b]) >= 0.8:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(texts))]


def test_signatures_are_unbiased():
    rng = random.Random(3)
    base = words(rng, 300)
    a, b = base + " " + " ".join([base[:200]] * 3), edited(rng, base, 12) + " " + base[:200]
    doc, element, count = multisets([a, b])
    sig = bag_signatures(doc, element, count, 2, 8192)
    true = overlap((element[doc == 0], count[doc == 0]), (element[doc == 1], count[doc == 1]))
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / 8192)


def test_signature_does_not_depend_on_the_batch():
    rng = random.Random(4)
    texts = [words(rng, n) for n in (1, 4, 7, 90, 400)]
    doc, element, count = multisets(texts)
    together = bag_signatures(doc, element, count, len(texts), 64)
    for i, t in enumerate(texts):
        d, e, c = multisets([t])
        assert (bag_signatures(d, e, c, 1, 64)[0] == together[i]).all()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [words(rng, rng.randint(3, 150)) for _ in range(40)]
    hot = words(rng, 120)
    texts += [edited(rng, hot, rng.randint(0, 7)) for _ in range(60)]  # one large group of near copies
    shared = words(rng, 70)
    texts += [shared + " " + words(rng, 40) for _ in range(40)]  # a common passage, otherwise different
    texts += [t for t in texts[:10] for _ in range(3)] + [texts[0].upper() + "!"]
    texts += ["", None, "  ", "!!!", "!!!", "a", "a", "a b", words(rng, 20000)]
    return list(enumerate(texts))


def test_groups_equal_brute_force(docs_of, corpus):
    got = near_duplicate_groups(docs_of(corpus)).collect()
    assert len(got) == len(corpus)
    first = {}
    for r in got:
        first[r.root] = min(first.get(r.root, 10**9), r["__cs_id"])
    assert [first[r.root] for r in sorted(got, key=lambda r: r["__cs_id"])] == brute_groups([t or "" for _, t in corpus])


def test_verified_pairs_hold_the_group_together(docs_of):
    rng = random.Random(11)
    hot = words(rng, 120)
    got = near_duplicate_groups(docs_of([(i, edited(rng, hot, 1)) for i in range(12)] + [(12, words(rng, 50))])).collect()
    pairs = {r["__cs_id"]: r.n_verified for r in got}
    assert "n_links" not in got[0].asDict() and pairs.pop(12) == 0
    assert all(pairs.values()) and sum(pairs.values()) >= 2 * 11  # a tree at least, not every similar pair


def test_keep_one_with_null_ids_and_repeated_rows(docs_of):
    rng = random.Random(6)
    a, b, c = words(rng, 60), words(rng, 50), words(rng, 40)
    rows = [(5, a), (5, a), (3, edited(rng, a, 1)), (None, b), (None, b), (None, c), (8, c), (9, None), (9, "")]
    docs = docs_of(rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, rows[2][1]), (None, b), (8, c), (9, next(t for i, t in got if i == 9))], key=str)


def test_empty_table(docs_of):
    docs = docs_of([(1, "x")]).where("doc_id > 1")
    assert keep_one(docs).count() == 0
    assert remove_repeated_spans(docs).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.range(200).select(F.col("id").cast("string").alias("a"), (F.col("id") + 1).cast("string").alias("b"))
    assert components(links).select("root").distinct().count() == 1


def brute_spans(rows):
    """Texts less their repeated spans, from a dictionary of first places."""
    first, places = {}, []
    for i, t in rows:
        d, s, e, h = spans_of([t or ""], 2, 24, 50)
        places += [(i, int(a), int(z), int(x)) for a, z, x in zip(s, e, h, strict=True)]
    for i, a, _, x in places:
        first[x] = min(first.get(x, (10**9, 0)), (i, a))
    out = {}
    for i, t in rows:
        text, at = t or "", 0
        kept = []
        for a, z in merged((a, z) for j, a, z, x in places if j == i and first[x] != (i, a)):
            kept.append(text[at:a])
            at = z
        out[i] = "".join([*kept, text[at:]])
    return out


def test_repeated_spans_equal_brute_force(docs_of):
    rng = random.Random(7)

    def prose(n):
        return " ".join(words(rng, rng.randint(2, 16)).capitalize() + rng.choice([".", "!", "?"]) for _ in range(n))

    passages = [prose(n) for n in (5, 8, 12)] + [words(rng, 60) + "."]
    rows = []
    for i in range(60):
        parts = [prose(rng.randint(0, 6))] + [rng.choice(passages) for _ in range(rng.randint(0, 2))] + [prose(3)]
        rows.append((i, rng.choice([" ", "\n", "\n\n"]).join(parts)))
    rows += [(60, None), (61, ""), (62, "one"), (63, passages[1]), (64, passages[1] + "\n" + passages[1])]
    got = {r.doc_id: r.text for r in remove_repeated_spans(docs_of(rows)).collect()}
    assert got == brute_spans(rows)
    # a passage of over 50 words that stands on lines of its own is wholly removed but for its first place
    for p in passages:
        if len(p.split()) > 50:
            assert sum(t.count(p) for t in got.values()) == 1


def test_repeated_spans_in_wide_and_quoted_lines(docs_of):
    rng = random.Random(12)
    wide = "".join("漢 字 " * 8 + f"{k}。" for k in range(4))  # no blank after a stop
    quoted = " ".join(f'"{words(rng, 15)}."' for _ in range(4))
    rows = [(1, "一。" + wide + "二三"), (2, "四五。" + wide + "六"), (3, "One. " + quoted + " Two three"), (4, "Four five. " + quoted + " Six")]
    got = {r.doc_id: r.text for r in remove_repeated_spans(docs_of(rows)).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert got[2] == "四五。六" and got[4] == "Four five. Six"


def test_limit_of_passages_glued_to_other_text(docs_of):
    """README: a passage glued to differing text keeps one whole sentence of under 50 words, and is not found."""
    rng = random.Random(13)
    one, two = (words(rng, 30).capitalize() + "." for _ in range(2))
    rows = [(1, f"Heading {one} {two} Tail."), (2, f"Other title {one} {two} End."), (3, f"Third.\n{one} {two}\nLast."), (4, f"Fourth.\n{one} {two}\nStop.")]
    got = {r.doc_id: r.text for r in remove_repeated_spans(docs_of(rows)).collect()}
    assert [got[i] == t for i, t in rows] == [True, True, True, False]
    assert one not in got[4] and two not in got[4]


def test_repeated_rows_are_one_document(docs_of):
    rng = random.Random(8)
    text = " ".join(words(rng, 12).capitalize() + "." for _ in range(6))
    docs = docs_of([(1, text), (1, text), (2, text), (None, "short.")])
    got = remove_repeated_spans(docs)
    assert got.columns == [*docs.columns, "cuts"]
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("1", text), ("1", text), ("2", ""), ("None", "short.")]

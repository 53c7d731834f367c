"""Language identification, decontamination, token counts, packing and fingerprints."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from claimscope.llm import fingerprints as fp
from claimscope.llm.decontaminate import align, contaminated, drop_contaminated
from claimscope.llm.language_id import keep_known_language, predict, train
from claimscope.llm.packing import WordEncoder, hilbert_keys, pack, tokenizer_path
from claimscope.llm.token_counts import count_in, section_tokens, token_edges
from claimscope.llm.token_counts import tokenizer_path as byte_path
from claimscope.llm.words import sentences_of, words_of

LANGS = {"xx": "abcdelmno", "yy": "xyzwvutsr", "zz": "aeioukpt"}


def words(rng, n, letters="abcdefghijklmnop"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_texts(rng):
    return [None, "", " ", "\n\n", "...", "1234", "a", "É", "漢字かな", "x" * 300_000, "a\x01b \x01 c", "<|endoftext|> tail", "Σας ΟΔΟΣ", "👍🏽 été ｆｕｌｌ", "it's we'll\tgo now end", words(rng, 9000)]


# ---- words -------------------------------------------------------------------------------------------------
def test_words_and_sentences():
    w = words_of(["Ab cd! EF", "", "ab cd ef", "ÉTÉ été"])
    assert np.diff(np.searchsorted(w.doc, range(5))).tolist() == [3, 0, 3, 2]
    assert w.hash[:3].tolist() == w.hash[3:6].tolist() and w.hash[6] == w.hash[7]
    s = sentences_of(words_of(["One two. Three!\n\n(four) -- 5.5 six", "", "..."]))
    assert s.words.tolist() == [2, 1, 4] and s.doc.tolist() == [0, 0, 0]


def test_sentences_with_closing_quotes_and_wide_stops():
    of = lambda t: sentences_of(words_of([t]))
    text = 'He said "one two." Then (three four.) Five!”\'» six. 5.5 "a"b.'
    s = of(text)
    assert [text[a:z].strip() for a, z in zip(s.start, s.end, strict=True)] == ['He said "one two."', "Then (three four.)", "Five!”'»", "six.", '5.5 "a"b.']
    text = "一二。三四！「五六。」七八？九"
    s = of(text)
    assert [text[a:z] for a, z in zip(s.start, s.end, strict=True)] == ["一二。", "三四！", "「五六。」", "七八？", "九"]
    assert of(')"one two').words.tolist() == [2] and of("..)))").words.tolist() == []


# ---- language ------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, 30, LANGS[k]), k, "x") for i, k in enumerate(sorted(LANGS) * 60)]
    rows += [(1000, None, "xx", "x"), (1001, "text", None, "x"), (None, "abc", "xx", "x"), (1002, "", None, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")


def test_languages_of_held_out_documents(labelled):
    model = train(labelled)
    assert model.langs == ["xx", "yy", "zz"]
    got = predict(labelled.select("doc_id", "text", "lang"), model).where("crc32(cast(doc_id as string)) % 3 = 1 and doc_id < 1000").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 < r.score <= 1 for r in got)


def test_language_of_odd_texts(spark, labelled):
    model = train(labelled)
    texts = odd_texts(random.Random(2))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in predict(docs, model).collect()}
    for i, t in enumerate(texts):
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
        assert (got[i].score == 0) == (got[i].lang_pred == "und")
    assert predict(docs.where("doc_id < 0"), model).count() == 0
    assert {r.lang_pred for r in predict(docs, train(labelled.where("doc_id < 0"))).collect()} == {"und"}


def test_astral_characters_are_letters_only_if_they_are(spark, labelled):
    model = train(labelled)
    texts = ["👍 🎉 123", "🎉", "𝟙𝟚", "𠮷野", "𝐚", "🎉𐐨🎉", "𐐀 1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in predict(docs, model).collect()}
    for i, t in enumerate(texts):
        assert (got[i].lang_pred == "und") == (got[i].score == 0) == (not any(c.isalpha() for c in t))
    assert keep_known_language(labelled.unionByName(docs.where("doc_id < 3").selectExpr("doc_id + 2000 as doc_id", "text", "'xx' as lang", "'x' as score"))).where("doc_id >= 2000").count() == 0


def test_stage_keeps_columns_and_clean_documents(labelled):
    kept = keep_known_language(labelled)
    assert kept.columns == labelled.columns
    assert kept.where("doc_id < 1000").count() == 180 and kept.where("doc_id in (1000, 1002)").count() == 0


# ---- decontamination -----------------------------------------------------------------------------------------
def brute_score(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(1)
    a = [rng.integers(0, 5, rng.integers(0, 20)) for _ in range(60)]
    b = [rng.integers(0, 5, rng.integers(0, 40)) for _ in range(60)]
    assert align(a, b).tolist() == [brute_score(x, y) for x, y in zip(a, b, strict=True)]


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(3)
    items = [(i, words(rng, rng.randint(14, 60))) for i in range(20)] + [(20, None), (21, ""), (22, "two words"), (23, None)]
    items.append((24, items[0][1]))  # an equal item
    items.append((None, words(rng, 20)))
    docs, truth = [], set()
    for i in range(80):
        text = words(rng, rng.randint(0, 200))
        if i % 2:
            k = rng.randrange(20)
            w = items[k][1].split()
            if i % 4 == 1:
                for _ in range(len(w) // 8):
                    w[rng.randrange(len(w))] = words(rng, 1)
            if i % 8 == 3:
                del w[rng.randrange(len(w))]
            text += "\n" + " ".join(w).upper() + ". " + words(rng, 50)
            truth |= {(i, k)} | ({(i, 24)} if k == 0 else set())
        docs.append((i, text))
    docs += [(80, None), (81, ""), (82, items[-1][1]), (83, items[3][1] + " " + words(rng, 30) + " " + items[3][1])]
    return docs, items, truth | {(82, None), (83, 3)}


def test_copies_and_edited_copies_are_found(spark, docs_of, leaks):
    docs, items, truth = leaks
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, words string")
    got = contaminated(docs_of(docs), bench).collect()
    assert sorted(((r["__cs_id"], r.item_id) for r in got), key=str) == sorted(truth, key=str)
    clean = drop_contaminated(docs_of(docs), bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted({i for i, _ in docs} - {i for i, _ in truth})
    assert clean.columns == docs_of(docs).columns
    assert drop_contaminated(docs_of(docs), bench.where("item_id < 0")).count() == len(docs)
    assert contaminated(docs_of(docs).where("doc_id < 0"), bench).count() == 0


def test_items_of_one_or_two_words_are_found(spark, docs_of):
    bench = spark.createDataFrame([(1, "Yes"), (2, "two words"), (3, ""), (4, "three short words"), (5, "?!")], "item_id bigint, text string")
    docs = docs_of([(1, "yes"), (2, "Two words."), (3, "words two"), (4, "here are two, words and yes at the end"), (5, ""), (6, None), (7, "three short words"), (8, "yesterday")])
    got = {(r["__cs_id"], r.item_id): (r.score, r.item_words) for r in contaminated(docs, bench).collect()}
    assert got == {(1, 1): (1, 1), (2, 2): (2, 2), (4, 1): (1, 1), (4, 2): (2, 2), (7, 4): (3, 3)}
    assert contaminated(docs, bench.where("item_id in (3, 5)")).count() == 0


def test_copies_with_an_edit_every_few_words_are_found(spark, docs_of):
    rng = random.Random(10)
    items = [(i, words(rng, 40)) for i in range(12)]
    docs = [(100, items[0][1]), (101, items[1][1])]  # exact copies of two beside the edited ones
    for i, t in items:
        w = t.split()
        for every in (4, 5):
            for shift in (every - 1, rng.randrange(every)):
                edited = [words(rng, 1) if k % every == shift else x for k, x in enumerate(w)]
                docs.append((len(docs), words(rng, 30) + "\n" + " ".join(edited) + " " + words(rng, 30)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["__cs_id"], r.item_id): r.score for r in contaminated(docs_of(docs), bench).collect()}
    want = {(d, i): brute_score(t.split(), x.split()) for d, x in docs for i, t in items}
    want = {k: v for k, v in want.items() if v >= 20}
    assert got == want and len(want) >= 40


# ---- tokens ----------------------------------------------------------------------------------------------------
def test_sections_add_up_and_shares_equal_brute_force(docs_of):
    texts = odd_texts(random.Random(4)) + ["one two\nthree\n\nfour", "no feed"]
    docs = docs_of(list(enumerate(texts)))
    for rule in ("start", "end", "share"):
        rows = section_tokens(docs, rule=rule).collect()
        for i, t in enumerate(texts):
            own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.section)
            assert sum(r.n_chars for r in own) == len(t or "") and len(own) == max(1, len((t or "").splitlines() if False else [x for x in (t or "").split("\n")]) - (t or "").endswith("\n"))
            assert abs(sum(r.n_tokens for r in own) - own[0].doc_tokens) < 1e-6
            assert own[0].doc_tokens == len(token_edges(t or "", byte_path())) - 1


def test_crossing_tokens_go_by_rule():
    edges = np.array([0, 3, 5, 9])
    start, end = np.array([0, 4, 4, 2]), np.array([4, 9, 4, 4])
    assert count_in(edges, start, end, "start").tolist() == [2, 1, 0, 1]
    assert count_in(edges, start, end, "end").tolist() == [1, 2, 0, 1]
    assert np.allclose(count_in(edges, start, end, "share"), [1.5, 1.5, 0, 1 / 3 + 0.5])


def test_given_sections(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma", [(0, 5), (6, 10), (-3, 99)]), (2, "x", None), (3, None, [])], "doc_id bigint, text string, s array<struct<start:bigint,end:bigint>>")
    rows = section_tokens(docs, sections_col="s").orderBy("doc_id", "section").collect()
    assert [(r.doc_id, r.section, r.n_chars) for r in rows] == [(1, 0, 5), (1, 1, 4), (1, 2, 16)]
    assert rows[2].n_tokens == rows[2].doc_tokens


# ---- packing ---------------------------------------------------------------------------------------------------
def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = [t or "" for t in odd_texts(rng)] + [words(rng, 200) + rng.choice([".", "!? ", "'s", " 12,5"]) for _ in range(50)]
    plain = Tokenizer.from_file(tokenizer_path())
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    encoder = WordEncoder(tokenizer_path())
    assert encoder.encode(texts) == want and encoder.encode(texts) == want


def test_encoder_looks_a_word_up_once_for_all_its_forms():
    encoder = WordEncoder(tokenizer_path())
    model, asked = encoder.model, []

    class Counted:
        def tokenize(self, word):
            asked.append(word)
            return model.tokenize(word)

    encoder.model = Counted()
    want = [encoder._ids("Alpha, b\u00e9ta"), encoder._ids("alpha B\u00c9TA. ALPHA.")]
    got = [np.frombuffer(encoder.encode([t])[0], "<u2").tolist() for t in ("Alpha, b\u00e9ta", "alpha B\u00c9TA. ALPHA.")]
    assert got == want and len(asked) == 2
    encoder.known_words = 6  # the memory starts anew in the middle of a text's words
    for text in ("alpha gamma delta", "alpha  epsilon, gamma zeta", "b\u00e9ta alpha 12 $$ eta"):
        assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == encoder._ids(text)


def test_lean_tasks_leave_no_encoder_behind(monkeypatch):
    import claimscope.llm.common as C
    import claimscope.llm.packing as P

    held = []
    monkeypatch.setattr(C, "hand_back", lambda: held.append(P._encoder.cache_info().currsize))

    def task(batches):
        for b in batches:
            yield P._encoder(tokenizer_path(), 50).encode(b)

    assert [len(x) for x in C.lean(task)([["one two", None or ""]])] == [2]
    assert held == [0]


@pytest.mark.parametrize("how", [{"known_words": 5, "lasting": False}, {"known_words": 5}])
def test_packing_is_the_same_with_little_memory(docs_of, how):
    rng = random.Random(8)
    docs = docs_of([(i, words(rng, rng.randint(0, 80))) for i in range(40)] + [(40, None)])
    want, got = (sorted(map(tuple, pack(docs, length=64, **x).collect())) for x in ({}, how))
    assert want == got


def test_hilbert_neighbours_touch():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    order = side[np.argsort(hilbert_keys(side, 3))]
    assert sorted(hilbert_keys(side, 3)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("length", [16, 4096])
def test_every_token_lies_in_one_piece(docs_of, length):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    texts = [t for t in odd_texts(rng) if len(t or "") < 100_000] + [words(rng, rng.randint(0, 300)) for _ in range(60)] + ["same text"] * 30
    rows = [(i, t) for i, t in enumerate(texts)]
    plain = Tokenizer.from_file(tokenizer_path())
    got = pack(docs_of(rows), length=length).toPandas()
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        own = got[got.doc_id == i].sort_values("start")
        assert np.concatenate([np.frombuffer(x, "<u2") for x in own.ids]).tolist() == ids
        assert (own.doc_tokens == len(ids)).all()
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes())
    seq = got.sort_values(["sequence_id", "offset"])
    assert (seq.groupby("sequence_id").length.cumsum() - seq.length == seq.offset).all()
    size = got.groupby("sequence_id").length.sum()
    assert (size <= length).all() and ((size & (size - 1)) == 0).all()
    assert pack(docs_of(rows).where("doc_id < 0")).count() == 0


# ---- fingerprints ------------------------------------------------------------------------------------------------
def brute_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    return {r[0]: (order[(k + 1) % len(order)][1] or "") for k, r in enumerate(order)}


def test_next_document_over_buckets(docs_of):
    rng = random.Random(7)
    rows = [(rng.randrange(10**6) ** 2, f"text {k}") for k in range(200)] + [(None, "null id"), (-5, None)]
    for buckets in (1, 2, 7, 64):
        got = {r.doc_id: r.next for r in fp.with_next(docs_of(rows), buckets=buckets).collect()}
        assert got == brute_next(rows)
    assert [(r.doc_id, r.next) for r in fp.with_next(docs_of([(1, "a")])).collect()] == [(1, "a")]
    assert fp.with_next(docs_of([(1, "a")]).where("doc_id < 0")).count() == 0
    assert sorted(r.next for r in fp.with_next(docs_of([(1, "a"), (1, "a"), (1, "b")])).collect()) == ["a", "a", "b"]


def test_trees(spark):
    texts = odd_texts(random.Random(8))[1:] + ["a. b", "a.\nb", "a. \nb", "a.\u001eb", "a. \u001eb", "one\ntwo\n" * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", "text", fp.tree(fp.F.col("text")).alias("t")).collect()
    assert len({r.t.root for r in rows}) == len(set(texts))
    for r in rows:
        assert [s["first"] for s in r.t.sections] == [1, *[s["last"] + 1 for s in r.t.sections[:-1]]]
        assert r.t.sections[-1]["last"] == len(r.t.paragraphs) == r.text.count("\n") + 1
        h = lambda x: hashlib.sha256("".join(x).encode()).hexdigest()
        assert [s["hash"] for s in r.t.sections] == [h([h(p) for p in r.t.paragraphs[s["first"] - 1 : s["last"]]]) for s in r.t.sections]


def test_changed_sections_locate_an_edit(spark):
    rng = random.Random(9)
    lines = [words(rng, 12) for _ in range(80)]
    other = lines[:40] + ["an edited line"] + lines[41:]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string").select(fp.tree(fp.F.col("a")).alias("a"), fp.tree(fp.F.col("b")).alias("b"))
    r = df.select(fp.changed_sections(fp.F.col("a"), fp.F.col("b")).alias("d"), fp.changed_sections(fp.F.col("a"), fp.F.col("a")).alias("none"), fp.likeness(fp.leaf_set(fp.F.col("a")), fp.leaf_set(fp.F.col("b"))).alias("like")).first()
    assert r.none == [] and 0.9 < r.like < 1
    assert any(s["first"] <= 41 <= s["last"] for s in r.d) and sum(s["last"] - s["first"] + 1 for s in r.d) < 40

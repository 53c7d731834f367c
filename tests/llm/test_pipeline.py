"""The pipeline on a small folder of tables."""

import random

import corpus_pipeline
from claimscope.llm.common import new_folder


def words(rng, n, letters="abcdefghijklmnop"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def prose(rng, n):
    return " ".join(words(rng, rng.randint(6, 14)).capitalize() + "." for _ in range(n))


def test_stages(spark):
    rng = random.Random(1)
    clean = [prose(rng, rng.randint(4, 12)) for _ in range(30)]
    passage, item = prose(rng, 7), words(rng, 40)
    rows = list(enumerate(clean))
    rows += [(100, clean[0]), (101, clean[1].replace(".", " !", 1)), (102, None), (103, "123 ... 456"), (104, "")]
    rows += [(110, prose(rng, 3) + "\n" + passage + "\n" + prose(rng, 3)), (111, prose(rng, 4) + "\n" + passage + "\n" + prose(rng, 2))]
    rows += [(120, prose(rng, 5) + "\n" + item + ".\n" + prose(rng, 3))]
    docs = spark.createDataFrame([(i, t, "xx", "src0", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    folder = new_folder(spark, "tables")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = kept.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == columns
        seen.append({r.doc_id: r for r in kept.collect()})
    every = {i for i, _ in rows}
    assert set(seen[0]) == every - {102, 103, 104}
    assert set(seen[1]) == set(seen[0]) - {100, 101}
    assert passage in seen[2][110].text and passage not in seen[2][111].text
    assert all(r.n_chars == len(r.text) for r in seen[2].values())
    assert set(seen[3]) == set(seen[2]) - {120}
    assert all(seen[3][i].text == t for i, t in enumerate(clean))
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(seen[3])

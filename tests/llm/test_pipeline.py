"""The pipeline's stages on odd rows: their decisions, columns and order."""

import itertools
import os
import random

import pytest

import corpus_pipeline
from __spark_entry__ import queries
from test_operators import plain_classes, plain_print


def test_stages(spark, odd, odd_rows):
    out = {}
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").persist()
        out[name] = docs
        if name != "pack":
            assert docs.columns == odd.columns
    ids = {name: [r["doc_id"] for r in df.select("doc_id").collect()] for name, df in out.items()}
    # without a letter: gone; all else stays
    assert sorted(map(str, ids["language_id"])) == sorted(str(r[0]) for r in odd_rows if r[0] not in (300, 301, 302, 303))
    assert 200 not in ids["near_dedup"] and 201 not in ids["near_dedup"] and ids["near_dedup"].count(305) == 0 and 7 in ids["near_dedup"]
    assert ids["secret_scans"].count(308) == 1 and not out["secret_scans"].where("text like '%AKIAABCDEFG%'").count()
    assert set(ids["source_mix"]) <= set(ids["secret_scans"]) and set(ids["pack"]) == set(ids["source_mix"])


def test_empty(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present")
def test_queries_run(spark):
    names = [q for q in queries() if q.startswith("op") or q == "pipeline"]
    assert len(names) == 14
    assert queries()["pipeline"](spark, "/root/testdata/sf0.001").count() > 0


def test_one_document_of_each_simhash_group_stays(spark):
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for g in range(30):
        base = say(400)
        for k in range(4):
            words = list(base)
            for at in rng.sample(range(400), [0, 1, 2, 40][k]):
                words[at] = "edited" + str(rng.randrange(10**6))
            rows.append((4 * g + k, " ".join(words)))
    rows += [(500 + i, t) for i, t in enumerate([None, "", " \n", rows[0][1].upper(), rows[4][1]])]
    prints = [plain_print(t) for _, t in rows]
    group = plain_classes(prints, 4)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == {min(i for (i, _), h in zip(rows, group) if h == g) for g in group} and 30 < len(got) < 110

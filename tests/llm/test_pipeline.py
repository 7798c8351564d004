"""The pipeline's stages on a small table: each takes effect and passes the columns on."""

import random
import re

import pytest

import corpus_pipeline
from millrace.llm._shared import materialize, release

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    unit, at = random.Random(1), tmp_path_factory.mktemp("tables")
    words = [f"word{k}" for k in range(400)]
    rows, labels = [], []
    for k in range(240):
        text = " ".join(unit.choice(words) for _ in range(unit.randint(30, 90))) + "."
        good = k % 4 != 0
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split()[:5] * 9)
        elif k % 6 == 1:
            text += f" mail me.{k}@mail.example.com now"
        rows.append((k, text, "en", f"s{k % 3}", len(text)))
        labels.append((k, int(good), 0))
    rows += [(1000 + k, *rows[1][1:]) for k in range(5)] + [(2000, rows[2][1] + " more", "en", "s0", 9), (None, rows[5][1], "en", None, 9), (3000, None, None, None, None), (3001, "", "en", "s1", 0), (7, *rows[7][1:])]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), name)
        seen[name] = docs.collect()
        assert docs.columns == names or name == "packing"
    ids = {k: [r.doc_id for r in v] for k, v in seen.items()}
    assert {k for k in range(240) if k % 4} <= set(ids["quality"]) and sum(k in ids["quality"] for k in range(0, 240, 4)) <= 2
    assert not {1000, 1001, 2000} & set(ids["near_duplicates"]) and ids["near_duplicates"].count(1) == 1 and ids["near_duplicates"].count(7) == 1
    assert sorted(ids["private_data"], key=str) == sorted(ids["near_duplicates"], key=str)
    assert not any(re.search(r"me\.\d+@mail", r.text or "") for r in seen["private_data"])
    assert max(ids["mixing"].count(k) for k in set(ids["mixing"]) - {None}) <= 2 and set(ids["mixing"]) <= set(ids["private_data"])
    assert set(ids["packing"]) == set(ids["mixing"])


def test_near_duplicates_lose_no_row_of_their_own(spark, folder):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(1, words(1)), (2, words(1)), (2, words(2)), (5, words(3)), (5, words(4)), (3, words(3) + " more"), (None, words(1)), (None, words(1)), (8, None), (8, None), (9, None), (10, "")]
    df = spark.createDataFrame([(i, t, f"l{k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, node string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, folder).collect()]
    want = [(1, words(1)), (2, words(2)), (3, words(3) + " more"), (5, words(4)), (None, words(1)), (None, words(1)), (8, None), (9, None), (10, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_columns_named_like_an_operators_own_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'a' score", "'b' predicted", "'c' held_out", "'d' n_entities", "'e' size", "'f' copies", "'g' target", "'h' kept", "'i' component_id", "'j' base")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), name)
        assert docs.columns == names
        assert {tuple(r) for r in docs.select(*names[5:]).distinct().collect()} == {tuple("abcdefghij")}


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 100
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_release_deletes_what_was_materialized(spark, tmp_path):
    made = materialize(spark.range(3), "x")
    path = made.inputFiles()[0]
    release(spark)
    with pytest.raises(Exception, match="(?i)path|exist"):
        spark.read.parquet(path).count()

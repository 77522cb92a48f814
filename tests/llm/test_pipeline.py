"""The pipeline's stages on nulls, copies, repeated rows, clashing columns and empty tables, and its run on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

BASE = " ".join(f"alpha{i} beta{i % 7} gamma" for i in range(80))
ITEM = "the benchmark question asks which river runs through the old town. The answer names the river near the bridge."
ROWS = [(1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace("alpha40", "delta"), "en", "b"), (4, "before it all " + ITEM + " after it all", "en", "b"), (5, None, None, None), (6, "", "en", "b"), (7, "short text here", "en", "a"), (7, "short text here", "en", "a"), (None, "no key", "en", "b")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("own") for c in ("_x", "score", "k", "copies")})
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 8)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def keys(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


def test_stages_keep_the_columns_and_decide_right(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert keys(cp.near_dedup(spark, docs, folder)) == sorted([1, 4, 5, 6, 7, None], key=str)
    assert keys(cp.decontaminate(spark, docs, folder)) == sorted([k for k, *_ in ROWS if k != 4], key=str)
    assert cp.tokens(spark, docs, folder).count() == len(ROWS)


def test_near_dedup_goes_by_texts(spark, folder):
    def text(word):
        return " ".join(f"{word}{i} and{i % 7}" for i in range(60))

    data = [(1, text("a")), (1, text("b")), (1, text("b")), (2, text("b")), (2, text("c")), (None, text("c")), (None, text("d")), (None, text("d")), (None, text("d").replace("d30", "e")), (3, None), (3, None), (4, None), (None, None), (None, None), (5, ""), (6, ""), (7, "!!"), (8, "!!")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("h", "class_id", "first")})
    got = [(r.doc_id, r.text) for r in cp.near_dedup(spark, docs, folder).collect()]
    loose = [x for x in got if x[0] is None and x[1]]
    assert len(loose) == 1 and "d1 " in loose[0][1]
    assert sorted((x for x in got if x not in loose), key=str) == sorted([(1, text("a")), (1, text("b")), (2, text("c")), (3, None), (4, None), (None, None), (None, None), (5, ""), (6, ""), (7, "!!")], key=str)


def test_items_without_an_id_are_searched_for(spark, folder, tmp_path):
    spark.createDataFrame([(None, ITEM), (None, "one more item that nobody has quoted so far. It asks for nothing at all."), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert keys(cp.decontaminate(spark, docs, str(tmp_path))) == sorted([k for k, *_ in ROWS if k != 4], key=str)


def test_run(spark):
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("the driver's tables aren't here")
    got = cp.run(spark, d).orderBy("start").collect()
    ends = [0]
    for r in got:
        assert r.start == ends[-1]
        ends.append(r.start + r.n_tokens)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got) and got


@pytest.mark.parametrize("kinds", [(0,), (1,), ()])
def test_labels_of_one_kind_decide_nothing(spark, tmp_path, kinds):
    docs = spark.createDataFrame([(i, f"some text {i} " * 40, "en", "s", 1) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, k, 0) for i in range(12) for k in kinds], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.quality(spark, docs, str(tmp_path)).count() == 12

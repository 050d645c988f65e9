"""Faults that were found in use, each as a small case."""

import pytest
from pyspark.sql import functions as F

from trackspark.llm import language_id, queries, topk, toxicity
from test_operators import prose


def test_a_language_of_long_texts_is_learned(spark):
    parts = {"en": "the and of that this with from ", "fr": "le la les est dans pour une "}
    rows = [(i, parts["en"] * 3, "en") for i in range(30)] + [(100 + i, parts["fr"] * 900 + f"{i}", "fr") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = language_id.identify(df, queries.held_out(3, 1)).collect()
    assert all(r["lang_pred"] == ("en" if r["doc_id"] < 100 else "fr") for r in told)


def test_a_document_with_very_many_rows_is_one_of_the_sample(spark):
    rows = [(1, "the and of that this with", "en")] * 2000 + [(i, "les dans pour une est la", "fr") for i in range(2, 12)] + [(i, "from this that with the", "en") for i in range(12, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(df, F.lit(True))
    assert model.names == ["en", "fr"]
    assert {r["lang_pred"] for r in language_id.identify(df, queries.held_out(3, 1)).filter("doc_id between 2 and 11").collect()} == {"fr"}


@pytest.mark.parametrize("marked", [1, 3])
def test_few_toxic_labels_still_teach(spark, marked):
    texts = [(i, prose(60, "abcdefgh"[i % 8]) + (" grobian und schuft grobian" if i < 12 else "") + f" end{i}") for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    learnable = [i for i, in docs.filter(~queries.held_out(5, 0)).filter("doc_id < 12").select("doc_id").collect()]
    labels = spark.createDataFrame([(i, 0, int(i < 12)) for i, _ in texts if i >= 12 or i in learnable[:marked]], "doc_id long, quality int, toxic int")
    told = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels, queries.held_out(5, 0)).collect()}
    assert min(told[i]["score"] for i in range(12)) > max(told[i]["score"] for i in range(12, 80))
    assert all(told[i]["predicted"] == int(i < 12) for i in told) or marked == 1


def test_equal_query_rows_are_one_query(spark):
    rows = [(50, [1.0, 0.0])] * 2 + [(i, [float(i) / 256, 0.0]) for i in range(1, 8)] + [(100, [1.0, 0.0]), (100, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 50)
    assert mine == [(1, 100, 65536), (2, 7, 1792), (3, 6, 1536), (4, 5, 1280), (5, 4, 1024)]
    assert sorted(r["rank"] for r in got if r["query_id"] == 100) == sorted([1, 2, 3, 4, 5] * 2)  # two vectors, two queries

"""The pipeline's stages, one after another, against brute force on what each received."""

from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import brute_components, hard_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    rows = [r[:5] for r in hard_rows()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    told = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == COLUMNS or name == "bpe"
        told[name] = out.collect()
        docs = spark.createDataFrame(told[name], out.schema)
    assert len(told["toxicity"]) == len(told["line_dedup"]) == len(rows)
    assert {r["doc_id"]: r["text"] for r in told["line_dedup"]}[8] == ""
    want = {d for d, v in brute_components([tuple(r) for r in told["line_dedup"]], 5, 80).items() if v[2]}
    assert {r["doc_id"] for r in told["minhash_near_dedup"]} - {None} == want
    assert {r["doc_id"] for r in told["mixing"]} <= {r["doc_id"] for r in told["minhash_near_dedup"]}
    assert sorted(str(r["doc_id"]) for r in told["bpe"]) == sorted(str(r["doc_id"]) for r in told["mixing"])
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, told["bpe"]))


def test_empty_tables_pass_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 0

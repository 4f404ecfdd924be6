"""The pipeline against what its operators give one by one."""

import corpus_pipeline
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality string, _copies int"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    text = lambda i: " ".join(f"w{i * 7 + j}" for j in range(40))
    rows = [(i, text(i), "en", f"s{i % 3}", 100, "q", 1) for i in range(30)]
    rows += [(100 + i, text(i), "en", "s0", 100, None, None) for i in range(5)] + [(200, "token = abcdefgh12345", None, None, 1, None, None), (201, None, None, None, None, None, None), rows[3], (None, "x", None, None, 1, "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        seen[name] = now
        assert now.columns == docs.columns
    assert seen["quality classifier"].count() == docs.count()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in seen["n-gram jaccard join"].select("doc_id").collect()) == sorted([(False, i) for i in [*range(30), 200, 201]] + [(True, 0)])
    assert seen["secret scans"].filter("doc_id = 200").first().text == "<secret>"
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert last.count() == now.count() == corpus_pipeline.run(spark, str(tmp_path)).count()
    assert last.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_keep_one_row_of_each_component(spark, tmp_path):
    text = lambda i, last="": " ".join(f"w{i * 1000 + j}" for j in range(40)) + last
    # id 7: a copy of 3 and a text of its own; id 8: two texts of its own; id 9: two near copies, and no id at all: a near copy of 3, and a text of its own twice
    rows = [(3, text(1, " z")), (7, text(1)), (7, text(2)), (8, text(3)), (8, text(4)), (9, text(5, " b")), (9, text(5, " a")), (None, text(1, " y")), (None, text(6)), (None, text(6)), (10, ""), (10, ""), (10, None), (None, " "), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), None, None) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.near_duplicates_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    want = [(3, text(1, " z")), (7, text(2)), (8, text(3)), (8, text(4)), (9, text(5, " a")), (None, text(6)), (10, ""), (10, None), (None, " "), (None, None)]
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted(want, key=repr)

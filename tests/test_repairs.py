"""Cases that once failed, and operators that SQL cannot express against brute force."""

import hashlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.functions import sequences as S
from spectraloom.operators import clean, metrics, spectra, splits
from spectraloom.sources import files
from spectraloom.streaming import ingest


def test_token_distance_of_many_distinct_tokens(spark):
    a = [f"[T{i}]" for i in range(300)]
    rows = [(a, [*a[:256], "[X]", *a[257:]]), (a, ["[Y]", *a[2:]]), (a, a), ([], a)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert [r.d for r in df.select(S.token_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [1, 2, 0, 300]


def test_null_keys_keep_their_rank(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "key string")
    assert sorted(r.place for r in splits.chunks(df, "key", 10).collect()) == [0, 1, 2]


def test_top_k_without_queries(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>")
    assert metrics.cosine_top_k(rows.limit(0), rows, 3).count() == 0


def test_replaced_table_survives_a_crash_between_renames(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_parquet(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t.old")
    files.replace_parquet(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "t.old").exists()


def test_fresh_checkpoint_keeps_the_registry(spark, tmp_path):
    schema = T.StructType([T.StructField("key", T.StringType())])
    source, registry = str(tmp_path / "in"), str(tmp_path / "reg")
    spark.createDataFrame([(f"k{i}",) for i in range(20)], schema).write.parquet(source)
    ingest.registry_ingest(spark, source, schema, "key", registry, str(tmp_path / "c1")).awaitTermination()
    first = {r.key: r.split for r in spark.read.parquet(f"{registry}/version=0").collect()}
    spark.createDataFrame([(f"k{i}",) for i in range(20, 60)], schema).write.mode("append").parquet(source)
    ingest.registry_ingest(spark, source, schema, "key", registry, str(tmp_path / "c2")).awaitTermination()
    last = {r.key: r.split for r in spark.read.parquet(f"{registry}/version=1").collect()}
    assert {r.key: r.split for r in spark.read.parquet(f"{registry}/version=0").collect()} == first
    assert len(last) == 60 and all(last[k] == s for k, s in first.items())


def test_hyperplane_hashes_against_numpy(spark):
    rows = [(1, [10.0, 55.0, 99.0, 150.0], [1.0, 2.0, 3.0, 9.0]), (2, [], []), (3, None, None), (4, [10.0, 55.0, 99.0], [1.0, 2.0, 3.0])]
    out = {r.k: r.lsh_hash for r in spectra.hyperplane_hashes(spark.createDataFrame(rows, "k long, mz array<double>, i array<double>"), "k", "mz", "i", 100.0, 10.0, 8).collect()}
    normal = np.random.RandomState(3).randn(8, 10)
    for k, mz, i in rows:
        vector = np.zeros(10)
        for m, x in zip(mz or [], i or []):
            if m < 100:
                vector[int(m / 10)] += x
        assert out[k] == hashlib.sha256((normal @ vector >= 0).tobytes()).hexdigest()
    assert out[1] == out[4] and out[2] == out[3]


def test_most_intense_peaks_match_first(spark):
    rows = [(1, "a", "x", 5.0, 0.2), (1, "a", "y", 5.0, 0.1), (1, "b", "y", 9.0, 0.3), (1, "b", "x", 9.0, 0.4), (1, "c", "x", 1.0, 0.0), (2, "a", "x", 1.0, 0.0)]
    out = spectra.match_most_intense_first(spark.createDataFrame(rows, "g long, l string, r string, i double, d double"), ["g"], "l", "r", "i", "d").collect()
    assert sorted((r.g, r.l, r.r) for r in out) == [(1, "a", "x"), (1, "b", "y"), (2, "a", "x")]


def test_columns_are_found_by_any_case():
    assert clean.find_column(["Title", "Seq"], ["sequence", "SEQ"]) == "Seq" and clean.find_column(["a"], ["b"]) is None

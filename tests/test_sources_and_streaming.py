import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.sources import files
from spectraloom.streaming import ingest


def test_shards_ipc_and_replacement(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "scan")
    df.coalesce(1).write.parquet(str(tmp_path / "a" / "PXD1"))
    assert files.scan_shards(spark, str(tmp_path / "a")).count() == 10
    files.replace_parquet(df.limit(3), str(tmp_path / "b"))
    files.replace_parquet(df.limit(2), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2
    table = pa.table({"scan": pa.array([1, 2], pa.int64()), "other": ["x", "y"]})
    with pa.OSFile(str(tmp_path / "x.ipc"), "wb") as sink, pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_table(table)
    assert [r.scan for r in files.scan_ipc(spark, str(tmp_path / "*.ipc"), T.StructType([T.StructField("scan", T.LongType())])).collect()] == [1, 2]


def test_mgf_record(spark):
    df = spark.createDataFrame([("s1", 2, 500.25, [100.0, 200.5], [1.0, 2.0])], "title string, charge int, pm double, mz array<double>, i array<double>")
    text = df.select(files.peak_list_text(*[F.col(c) for c in ("title", "charge", "pm", "mz", "i")]).alias("t")).first().t
    assert text == "BEGIN IONS\nTITLE=s1\nPEPMASS=500.250000\nCHARGE=2+\n100.0000 1.0000\n200.5000 2.0000\nEND IONS\n"


def test_registry_keeps_known_keys(spark, tmp_path):
    schema = T.StructType([T.StructField("key", T.StringType())])
    source, registry, check = (str(tmp_path / x) for x in ("in", "reg", "chk"))
    spark.createDataFrame([(f"k{i}",) for i in range(20)], schema).write.mode("append").parquet(source)
    ingest.registry_ingest(spark, source, schema, "key", registry, check).awaitTermination()
    first = {r.key: r.split for r in spark.read.parquet(f"{registry}/version=0").collect()}
    spark.createDataFrame([(f"k{i}",) for i in range(10, 40)], schema).write.mode("append").parquet(source)
    ingest.registry_ingest(spark, source, schema, "key", registry, check).awaitTermination()
    second = {r.key: r.split for r in spark.read.parquet(f"{registry}/version=1").collect()}
    assert len(first) == 20 and len(second) == 40 and all(second[k] == s for k, s in first.items())


def test_windowed_counts(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "a", 4.0)], "t string, event_type string, value double")
    out = ingest.windowed_counts(df.withColumn("ts", F.to_timestamp("t"))).orderBy("window").collect()
    assert [(r.n, r.total) for r in out] == [(2, 3.0), (1, 4.0)]

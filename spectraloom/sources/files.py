"""Scans and sinks: corpora of shards, Arrow IPC, peak-list text, atomic replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequences import stem


def scan_shards(spark: SparkSession, *roots: str, schema: T.StructType | None = None, pattern: str = "*.parquet") -> DataFrame:
    """All shards under the roots, with file (path) and experiment (stem); schemas are not merged."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("mergeSchema", "false")
    df = (reader.schema(schema) if schema else reader).parquet(*roots)
    path = F.col("_metadata.file_path")
    return df.select("*", path.alias("file"), stem(path).alias("experiment"))


def scan_ipc(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """Arrow IPC files: their bytes are read by Spark, so that any store will do, and decoded batch by batch."""
    import pyarrow as pa

    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                with pa.ipc.open_file(pa.BufferReader(content.as_buffer())) as reader:
                    for i in range(reader.num_record_batches):
                        yield reader.get_batch(i).select(names)

    return spark.read.format("binaryFile").load(pattern).select("content").mapInArrow(run, schema)


def replace_parquet(df: DataFrame, path: str) -> None:
    """Writes beside the path, then swaps. Between two renames the path is absent for a moment; what a crash has left there is put back by the next call."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, fresh, old = hadoop(path), hadoop(f"{path}.new"), hadoop(f"{path}.old")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target) and fs.exists(old):
        fs.rename(old, target)
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)


def peak_list_text(title, charge, precursor, mz, intensity):
    """One MGF record as a column."""
    lines = F.zip_with(mz, intensity, lambda m, i: F.concat_ws(" ", F.format_string("%.4f", m), F.format_string("%.4f", i)))
    head = F.concat(F.lit("BEGIN IONS\nTITLE="), title, F.lit("\nPEPMASS="), F.format_string("%.6f", precursor), F.lit("\nCHARGE="), charge.cast("string"), F.lit("+\n"))
    return F.concat(head, F.array_join(lines, "\n"), F.lit("\nEND IONS\n"))


def write_mgf(df: DataFrame, path: str, title: str, charge: str, precursor: str, mz: str, intensity: str) -> None:
    """A text file per partition."""
    df.select(peak_list_text(*[F.col(c) for c in (title, charge, precursor, mz, intensity)]).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def read_search_table(spark: SparkSession, path: str, key: str = "file") -> DataFrame:
    """Run metadata from CSV with its lookup key; keys that several rows claim are dropped."""
    rows = spark.read.option("header", "true").csv(path)
    keyed = rows.withColumn("key", stem(F.col(key)))
    unique = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("key")
    return keyed.join(unique, "key", "left_semi")

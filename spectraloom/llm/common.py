"""Shared pieces of the training-data operators: words, scratch tables, hashes."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, and its complement.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(*parts: Column | str) -> Column:
    """Uniform 60-bit hash of the parts, joined by '|', null as an empty part.

    md5-based, so that any SQL engine can repeat it.
    """
    text = F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset and all run on this machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spectraloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _remove(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop) if at_exit else fs.delete(hadoop, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below the application's own; removed when the driver's JVM ends, or by sweep()."""
    path = f"{scratch_root(spark)}/spectraloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _remove(spark, path, at_exit=True)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    _remove(spark, path)


def sweep(spark: SparkSession, application: str | None = None) -> None:
    """Removes what an application has left in the shared folder: this one, or one whose driver was killed."""
    _remove(spark, f"{scratch_root(spark)}/spectraloom/{application or spark.sparkContext.applicationId}")


#: Shuffle files go when the query that made them ends, and not only with the driver's next collection of garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and it outlives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with tidy_shuffles(spark):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
    out._scratch = path
    return out

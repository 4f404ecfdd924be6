"""Incremental ingest and event-time windows with Structured Streaming (an addition of this engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.splits import assign_hashes, merge_history


def registry_ingest(spark: SparkSession, source: str, schema: T.StructType, key: str, registry: str, checkpoint: str):
    """Assigns splits to the keys of new files only; each batch writes a new version of the registry, and known keys keep their split."""

    def version(number: int) -> str:
        return f"{registry}/version={number}"

    def newest() -> int:
        """The last whole version; -1 for none."""
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{registry}/version=*/_SUCCESS")
        found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
        return max((int(str(x.getPath().getParent().getName()).partition("=")[2]) for x in found or ()), default=-1)

    def batch(df: DataFrame, _: int) -> None:
        # a batch that is tried again finds its keys known, and a fresh checkpoint the registry as it is
        last = newest()
        empty = spark.createDataFrame([], T.StructType([schema[key], T.StructField("split", T.StringType())]))
        history = spark.read.parquet(version(last)) if last >= 0 else empty
        assigned = assign_hashes(df.select(key).filter(F.col(key).isNotNull()).distinct(), history, key)
        merge_history(assigned, history, key).write.mode("overwrite").parquet(version(last + 1))

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums per event type and tumbling window; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

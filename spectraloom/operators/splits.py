"""Registry and hash splits, deterministic shuffles and shard routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_hash(key: Column, seed: int = 42) -> Column:
    """A repeatable order: md5 of seed and key, null as the empty key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def file_seed(path: Column, seed: int = 42) -> Column:
    return F.conv(F.substring(F.sha2(path, 256), 1, 8), 16, 10).cast("long") + seed


def keep_known(keys: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """LEFT join to earlier assignments: known keys keep their split, new ones are null."""
    return keys.join(history, key, "left")


def merge_history(batch: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """All assignments after a batch: history without the batch's keys, and the batch."""
    return history.join(batch, key, "left_anti").unionByName(batch)


def ranked(df: DataFrame, key: str, seed: int = 42, digits: int = 3) -> DataFrame:
    """+ _rank, from 0, in the order of the keys' hashes.

    Buckets are the hash's leading digits (16 ** digits of them); counts of buckets give
    each its first rank, and only buckets are sorted.
    """
    hashed = df.withColumn("_h", order_hash(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, digits))
    counts = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_b").orderBy("_h", key)
    return hashed.join(F.broadcast(first), "_b").withColumn("_rank", F.col("_first") + F.row_number().over(inside) - 1).drop("_h", "_b", "_first")


def assign_new(keys: DataFrame, history: DataFrame, key: str, ratios: tuple[tuple[str, float], ...] = (("train", 0.8), ("test", 0.1), ("valid", 0.1)), seed: int = 42) -> DataFrame:
    """Splits of the new keys by deficit against targets over all keys of the batch; shares are rounded half to even; saturated splits get none, the last absorbs the rest; with all saturated, the first does.

    Deficits are a row; new keys are dealt out by their hash rank.
    """
    last = ratios[-1][0]
    total = keys.agg(F.count(F.lit(1)).alias("_total"))
    known = keys.join(history, key, "left_semi").join(history, key).agg(*[F.count_if(F.col("split") == s).alias(f"_k_{s}") for s, _ in ratios])
    new = keys.join(history, key, "left_anti")
    size = new.agg(F.count(F.lit(1)).alias("_new"))
    facts = total.crossJoin(known).crossJoin(size)
    facts = facts.withColumns({f"_d_{s}": F.greatest(F.bround(F.col("_total") * r).cast("long") - F.col(f"_k_{s}"), F.lit(0).cast("long")) for s, r in ratios})
    deficits = sum((F.col(f"_d_{s}") for s, _ in ratios), F.lit(0))
    facts = facts.withColumn("_deficit", deficits)
    end, choice = F.lit(0).cast("long"), F.lit(last)
    ends = []
    for s, _ in ratios[:-1]:
        end = end + F.coalesce(F.bround(F.try_divide(F.col("_new") * F.col(f"_d_{s}"), F.col("_deficit"))).cast("long"), F.lit(0).cast("long"))
        ends.append((s, end))
    for s, e in reversed(ends):
        choice = F.when(F.col("_rank") < e, F.lit(s)).otherwise(choice)
    choice = F.when(F.col("_deficit") == 0, F.lit(ratios[0][0])).otherwise(choice)
    return ranked(new, key, seed).crossJoin(F.broadcast(facts)).select(key, choice.alias("split"))


def assign_hashes(keys: DataFrame, history: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Unlabelled rule: targets round(.8 n), round(.1 n) and the rest of all keys of the batch; empty slots are filled in hash order, what is over goes to test."""
    placed = keep_known(keys, history, key)
    n = placed.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("split") == s).alias(f"_k_{s}") for s in ("train", "val")])
    slot = lambda s, r: F.greatest(F.round(F.col("_n") * r).cast("long") - F.col(f"_k_{s}"), F.lit(0).cast("long"))
    fresh = ranked(placed.filter("split IS NULL").select(key), key, seed).crossJoin(F.broadcast(n))
    train, val = slot("train", 0.8), slot("val", 0.1)
    split = F.when(F.col("_rank") < train, "train").when(F.col("_rank") < train + val, "val").otherwise("test")
    return placed.filter("split IS NOT NULL").select(key, "split").unionByName(fresh.select(key, split.alias("split")))


def route(rows: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Rows with the split of their key; unregistered keys raise when the row is reached."""
    missing = F.when(F.col("split").isNull(), F.raise_error(F.concat(F.lit("unregistered key "), F.col(key).cast("string")))).otherwise(F.col("split"))
    return rows.join(registry, key, "left").withColumn("split", missing.cast("string"))


def chunks(rows: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """Global shuffle cut into chunks: + chunk, place."""
    return ranked(rows, key, seed).withColumn("chunk", F.floor(F.col("_rank") / size).cast("long")).withColumn("place", F.pmod("_rank", F.lit(size)).cast("long")).drop("_rank")


def write_splits(rows: DataFrame, path: str, rows_per_file: int = 400_000) -> None:
    """One folder per split, files of at most rows_per_file rows."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("split").parquet(path)


def group_split(df: DataFrame, key: str, ratios: tuple[float, float] = (0.8, 0.1), seed: int = 42) -> DataFrame:
    """Group-disjoint split over distinct keys that are not null; at least three groups."""
    groups = ranked(df.select(key).filter(F.col(key).isNotNull()).distinct(), key, seed)
    total = groups.agg(F.count(F.lit(1)).alias("_n"))
    train, valid = F.round(F.col("_n") * ratios[0]), F.round(F.col("_n") * ratios[1])
    split = F.when(F.col("_rank") < train, "train").when(F.col("_rank") < train + valid, "valid").otherwise("test")
    return groups.crossJoin(F.broadcast(total)).select(key, split.alias("split"))


def chunk_size(ram_gb: float, procs: int, bytes_per_row: float, safety: float = 0.8, second_pass: bool = False) -> int:
    return int(ram_gb * 1024**3 * safety / procs * 0.6 / (bytes_per_row * (2 if second_pass else 1)))

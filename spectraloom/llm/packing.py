"""Packing documents into length buckets with the least padding.

The lengths of all documents are counted (one row per distinct length). Dynamic
programming over that histogram finds the bucket boundaries with the least total
padding: the cost of a bucket is what its documents lack to its longest one.
Inside each bucket, documents in hash order fill batches of a token budget.

No task sees a whole bucket: a bucket is cut into shards of about shard_rows
documents by ranges of the hash, counts of shards give every shard its first
place, and only shards are ranked.

Defined results: null or empty text has 0 tokens and lies in the first bucket; a
document longer than the budget is a batch of its own; rows have the hash of their id
and text, so that rows without an id, or with one id, are told apart; rows that are
equal in both are packed one by one, and those repeated more than shard_rows times
come last in their bucket; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, hash60, materialize, word_count


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` length buckets with the least padding; of equal solutions the one with the shortest early buckets.

    lengths ascend. Padding is a Monge cost, so the best split for length j never
    lies before that for j - 1: each layer takes n log n evaluations.
    """
    n = len(lengths)
    if not n:
        return []
    size = lengths.astype(object) if float(lengths[-1]) * float(counts.sum()) > 4e18 else lengths.astype(np.int64)
    many = np.cumsum(counts.astype(size.dtype))
    mass = np.cumsum(counts.astype(size.dtype) * size)
    cost = size * many - mass
    choice = []
    for layer in range(1, min(buckets, n)):
        best, arg = _layer(cost, size, many, mass, layer)
        choice.append(arg)
        cost = best
    bounds, j = [], n - 1
    for arg in reversed(choice):
        bounds.append(int(lengths[j]))
        j = int(arg[j])
    return [int(lengths[j]), *reversed(bounds)]


def _layer(cost: np.ndarray, size: np.ndarray, many: np.ndarray, mass: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """min over i < j of cost[i] + padding(i + 1 .. j) for every j >= first, and the least such i."""
    n = len(size)
    best, arg = cost.copy(), np.full(n, -1)
    low, high = np.full(n, first - 1), np.full(n, n - 2)
    rows = np.arange(first, n)
    step = 1 << max(0, (len(rows) - 1).bit_length())
    done: list[np.ndarray] = []
    while step:
        now = rows[step - 1 :: 2 * step]
        if len(now):
            known = np.sort(np.concatenate(done)) if done else np.empty(0, int)
            at = np.searchsorted(known, now)
            lo = np.where(at > 0, arg[known[np.maximum(at - 1, 0)]] if len(known) else first - 1, low[now])
            hi = np.where(at < len(known), arg[known[np.minimum(at, max(len(known) - 1, 0))]] if len(known) else 0, high[now])
            hi = np.minimum(hi, now - 1)
            width = hi - lo + 1
            start = np.cumsum(width) - width
            j = np.repeat(now, width)
            i = np.arange(width.sum()) - np.repeat(start, width) + np.repeat(lo, width)
            value = cost[i] + size[j] * (many[j] - many[i]) - (mass[j] - mass[i])
            least = np.minimum.reduceat(value, start)
            hit = np.flatnonzero(value == np.repeat(least, width))
            first_hit = hit[np.searchsorted(hit, start)]
            best[now], arg[now] = least, i[first_hit]
            done.append(now)
        step //= 2
    return best, arg


def pack(
    docs: DataFrame, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int = 8,
    token_budget: int = 16384, shard_rows: int = 50_000, seed: str = "pack",
) -> DataFrame:
    """One row per input row: id, n_tokens, bucket, bucket_len, batch, place, padding.

    length: tokens of a document, by default its words. batch counts from 0 in its
    bucket; its documents are padded to bucket_len and at most
    max(1, token_budget // bucket_len). The histogram on the driver has a row per
    distinct length, no more than the longest document has tokens.
    """
    length = word_count(F.col(text_col)) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    digest = F.md5(F.coalesce(F.col(text_col), F.lit(""))) if text_col in docs.columns else F.lit("")
    # r numbers the rows of this table: which of equal rows comes first does not matter
    slim = materialize(docs.select(F.col(id_col).alias("id"), length.alias("n_tokens"), hash60(F.lit(seed), F.col(id_col), digest).alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("r")), "pack")
    hist = slim.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").toPandas()
    sizes, counts = hist["n_tokens"].to_numpy(np.int64), hist["n"].to_numpy(np.int64)
    bounds = optimal_bounds(sizes, counts, buckets) or [0]
    last = np.searchsorted(sizes, bounds, side="right")
    rows = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(counts)])[last]]))
    number = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("bucket") + 1)
    bucket = sum((F.col("n_tokens") > b).cast("int") for b in bounds[:-1]) if len(bounds) > 1 else F.lit(0)
    dealt = slim.withColumn("bucket", bucket).withColumn("_shards", number([max(1, -(-int(r) // shard_rows)) for r in rows]))
    # hashes that repeat are few (rows / shard_rows at most): their rows are dealt to shards of their own
    hot = dealt.groupBy("bucket", "h").agg(F.count(F.lit(1)).alias("_many")).filter(F.col("_many") > shard_rows)
    dealt = dealt.join(F.broadcast(hot), ["bucket", "h"], "left")
    even = F.floor(F.col("h") / F.lit(2.0**60) * F.col("_shards")).cast("long")
    own = F.pmod("r", F.ceil(F.col("_many") / shard_rows))
    dealt = dealt.withColumn("_shard", F.struct(F.col("_many").isNotNull().alias("hot"), F.when(F.col("_many").isNull(), even).otherwise(F.col("h")).alias("cell"), F.coalesce(own, F.lit(0).cast("long")).alias("part")))
    per_shard = dealt.groupBy("bucket", "_shard").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    first = per_shard.select("bucket", "_shard", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_first"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("bucket", "_shard").orderBy("h", "r")) - 1)
    out = ranked.join(first, ["bucket", "_shard"])
    wide = number([max(1, b) for b in bounds])
    capacity = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / wide)).cast("long")
    place = F.col("_first") + F.col("_rank")
    return out.select(
        F.col("id").alias(id_col), "n_tokens", "bucket", number(bounds).cast("long").alias("bucket_len"),
        F.floor(place / capacity).cast("long").alias("batch"), F.pmod(place, capacity).cast("long").alias("place"),
        (number(bounds).cast("long") - F.col("n_tokens")).alias("padding"),
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
         ('0x' || substr(md5(concat_ws('|', 'pack', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 15))::BIGINT AS h
  FROM documents),
i AS (
  SELECT n_tokens AS l, row_number() OVER (ORDER BY n_tokens) AS j, sum(count(*)) OVER (ORDER BY n_tokens) AS c,
         sum(count(*) * n_tokens) OVER (ORDER BY n_tokens) AS w
  FROM d GROUP BY n_tokens),
dp AS (
  SELECT 1 AS k, j, l * c - w AS cost, [l] AS bounds FROM i
  UNION ALL
  SELECT k + 1, j, s.cost, list_append(s.bounds, l)
  FROM (SELECT dp.k, i.j, i.l, min(struct_pack(cost := dp.cost + i.l * (i.c - p.c) - (i.w - p.w), j := dp.j, bounds := dp.bounds)) AS s
        FROM dp JOIN i p ON p.j = dp.j JOIN i ON i.j > dp.j WHERE dp.k < 8 GROUP BY 1, 2, 3)),
b AS (
  SELECT bounds FROM dp WHERE k = least(8, (SELECT max(j) FROM i)) AND j = (SELECT max(j) FROM i)),
x AS (
  SELECT d.*, len(list_filter(bounds[:-2], lambda v: v < n_tokens))::INT AS bucket, bounds FROM d, b),
y AS (
  SELECT *, bounds[bucket + 1]::BIGINT AS bucket_len, greatest(1, 16384 // greatest(1, bounds[bucket + 1])) AS capacity,
         row_number() OVER (PARTITION BY bucket ORDER BY h, doc_id) - 1 AS place
  FROM x)
SELECT doc_id, n_tokens, bucket, bucket_len, (place // capacity)::BIGINT AS batch, (place % capacity)::BIGINT AS place, bucket_len - n_tokens AS padding
FROM y
"""

"""Statistics of rankings, probes and retrieval tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .splits import order_hash


def average_rank(value: str, by: list[str]) -> Column:
    """Rank within the group, ties with their mean rank."""
    group, ties = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return F.rank().over(group) + (F.count(F.lit(1)).over(ties) - 1) / 2


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation of each group, with mean ranks for ties."""
    ranked = df.withColumn("_x", average_rank(x, by)).withColumn("_y", average_rank(y, by))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("spearman"))


def cliffs_delta(df: DataFrame, by: list[str], x: str, high: Column) -> DataFrame:
    """P(high > low) - P(high < low) of each group, from counts by distinct value."""
    cells = df.groupBy(*by, x).agg(F.count_if(high).alias("_h"), F.count_if(~high).alias("_l"))
    w = Window.partitionBy(*by).orderBy(x)
    below = F.coalesce(F.sum("_l").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = F.coalesce(F.sum("_l").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    won = cells.withColumn("_w", F.col("_h") * (below - above))
    return won.groupBy(*by).agg(F.try_divide(F.sum("_w"), F.sum("_h") * F.sum("_l")).alias("delta"))


def normalised_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual information over the mean of the entropies."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("_c"))
    entropy = lambda k: cells.groupBy(k).agg(F.sum("_c").alias("_n")).agg(F.log(F.sum("_n")) - F.sum(F.col("_n") * F.log("_n")) / F.sum("_n"))
    parts = entropy(a).toDF("_ha").crossJoin(F.broadcast(entropy(b).toDF("_hb")))
    joint = cells.agg((F.log(F.sum("_c")) - F.sum(F.col("_c") * F.log("_c")) / F.sum("_c")).alias("_hj"))
    return parts.crossJoin(F.broadcast(joint)).select(F.when(F.col("_ha") + F.col("_hb") == 0, 1.0).otherwise(2 * (F.col("_ha") + F.col("_hb") - F.col("_hj")) / (F.col("_ha") + F.col("_hb"))).alias("nmi"))


def pooled(df: DataFrame, by: str, vector: str, weight: Column) -> DataFrame:
    """(by, place, value): L2-normalised weighted mean vector of each group; negative weights count as 0, none as equal."""
    rows = df.select(by, F.greatest(weight, F.lit(0.0)).alias("_w"), F.posexplode(vector).alias("place", "_v"))
    sums = rows.groupBy(by, "place").agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_t"), F.avg(F.col("_v").cast("double")).alias("_m"))
    mean = sums.withColumn("_x", F.when(F.col("_t") > 0, F.col("_s") / F.col("_t")).otherwise(F.col("_m")))
    length = F.greatest(F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy(by))), F.lit(1e-12))
    return mean.select(by, "place", (F.col("_x") / length).alias("value"))


def project_disjoint(sizes: DataFrame, project: str, n: str, share: float = 0.1, cap: float = 0.5) -> DataFrame:
    """Projects dealt out whole: the largest first to val, then to test, each until its capped sum reaches its share of all rows, the rest to train.

    A project counts for at most cap of a target. Sums run over one row a project.
    """
    total = sizes.agg(F.sum(n).alias("_t"))
    rows = sizes.crossJoin(F.broadcast(total)).withColumn("_g", F.col("_t") * share).withColumn("_c", F.least(F.col(n).cast("double"), F.col("_g") * cap))
    w = Window.orderBy(F.desc(n), project).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_c").over(w), F.lit(0.0))
    split = F.when(before < F.col("_g"), "val").when(before < 2 * F.col("_g"), "test").otherwise("train")
    return rows.withColumn("split", split).select(project, n, "split")


def seeded_sample(df: DataFrame, by: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group, by the hash of a unique key."""
    w = Window.partitionBy(*by).orderBy(order_hash(F.col(key), seed), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def uniformity(pairs: DataFrame, cosine: str, t: float = 2.0) -> DataFrame:
    """Mean and population deviation of cosines, and log mean exp(-t d^2) of unit vectors."""
    c = F.col(cosine)
    return pairs.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.log(F.avg(F.exp(-t * (2 - 2 * c)))).alias("uniformity"))


def ks_distance(df: DataFrame, by: list[str], x: str, positive: Column) -> DataFrame:
    """Largest gap of the cumulative shares of positives and others, and Cohen's d with the pooled sample variance."""
    cells = df.groupBy(*by, x).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    w, every = Window.partitionBy(*by).orderBy(x), Window.partitionBy(*by)
    gap = F.abs(F.sum("_p").over(w) / F.sum("_p").over(every) - F.sum("_n").over(w) / F.sum("_n").over(every))
    ks = cells.withColumn("_g", gap).groupBy(*by).agg(F.max("_g").alias("ks"))
    side = lambda c, k: [F.avg(F.when(c, F.col(x))).alias(f"_m{k}"), F.var_samp(F.when(c, F.col(x))).alias(f"_v{k}"), F.count_if(c).alias(f"_c{k}")]
    d = df.groupBy(*by).agg(*side(positive, 1), *side(~positive, 0))
    spread = F.sqrt(((F.col("_c1") - 1) * F.col("_v1") + (F.col("_c0") - 1) * F.col("_v0")) / (F.col("_c1") + F.col("_c0") - 2))
    return ks.join(d.select(*by, F.try_divide(F.col("_m1") - F.col("_m0"), spread).alias("cohens_d")), by)

"""Statistics over groups, retrieval and calibration metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def describe(df: DataFrame, by: list[str], x: str, least: int = 1) -> DataFrame:
    """n, mean, population deviation, least, most, exact percentiles, CV and IQR of groups of at least `least` rows; null and "unknown" groups are left out."""
    for b in by:
        df = df.filter(F.col(b).isNotNull() & (F.lower(F.col(b).cast("string")) != "unknown"))
    p = F.percentile(x, F.array(*[F.lit(q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    out = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"), p.alias("_p"))
    out = out.filter(F.col("n") >= least)
    for i, name in enumerate(("p5", "p25", "median", "p75", "p95")):
        out = out.withColumn(name, F.col("_p")[i])
    return out.withColumn("cv", F.try_divide("std", "mean")).withColumn("iqr", F.col("p75") - F.col("p25")).drop("_p")


def expected_calibration_error(df: DataFrame, confidence: str, correct: Column, bins: int = 15) -> DataFrame:
    """Bins are (low, high]; a confidence of 0 is in none."""
    cells = df.withColumn("_b", F.ceil(F.col(confidence) * bins)).filter((F.col("_b") >= 1) & (F.col("_b") <= bins))
    by_bin = cells.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"), F.avg(confidence).alias("_c"), F.avg(correct.cast("double")).alias("_a"))
    n = df.agg(F.count(F.lit(1)).alias("_all"))
    return by_bin.crossJoin(F.broadcast(n)).agg(F.sum(F.col("_n") / F.col("_all") * F.abs(F.col("_a") - F.col("_c"))).alias("ece"))


def auroc(df: DataFrame, score: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve from rank sums with average ties, computed over counts per distinct score."""
    by = by or []
    cells = df.groupBy(*by, score).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    below = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    won = cells.withColumn("_w", F.col("_p") * (F.coalesce(F.sum("_n").over(below), F.lit(0)) + F.col("_n") / 2))
    return won.groupBy(*by).agg(F.try_divide(F.sum("_w"), F.sum("_p") * F.sum("_n")).alias("auroc"))


def cosine_top_k(queries: DataFrame, library: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(id, vector) of both sides -> query_id, library_id, rank, score: exact, without self; ties by library id.

    Queries come in blocks of vectors; each block meets the library in one pass of
    matrix products, and only k rows per query and partition leave it.
    """
    import numpy as np
    import pandas as pd

    blocks = queries.select("id", "vector").withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries.count() // block)))))
    packed = blocks.groupBy("_b").agg(F.collect_list(F.struct("id", "vector")).alias("rows"))
    spread = library.select("id", "vector").repartition("id")
    out = None
    for row in packed.toLocalIterator():
        ids = np.array([r["id"] for r in row["rows"]])
        matrix = np.array([r["vector"] for r in row["rows"]], dtype=np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
        shared = library.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches, shared=shared):
            q, m = shared.value
            best: list = [None]
            for pdf in batches:
                if not len(pdf):
                    continue
                v = np.array(pdf["vector"].tolist(), dtype=np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                score = m @ v.T
                lib = pdf["id"].to_numpy()
                score = np.round(score, 9)
                score[q[:, None] == lib[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(lib, score.shape), -score), axis=1)[:, :k]
                new = pd.DataFrame({"query_id": np.repeat(q, order.shape[1]), "library_id": lib[order].ravel(), "score": np.take_along_axis(score, order, 1).ravel()})
                best[0] = new if best[0] is None else pd.concat([best[0], new]).sort_values(["query_id", "score", "library_id"], ascending=[True, False, True]).groupby("query_id").head(k)
            if best[0] is not None:
                yield best[0][np.isfinite(best[0]["score"])]

        part = spread.mapInPandas(run, "query_id bigint, library_id bigint, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return queries.sparkSession.createDataFrame([], "query_id bigint, library_id bigint, rank int, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "library_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "library_id", "rank", "score")


def recall_at(hits: DataFrame, by: str, relevant: Column, k: int) -> DataFrame:
    """Share of queries with a relevant row among the first k."""
    return hits.groupBy(by).agg(F.max(F.when((F.col("rank") <= k) & relevant, 1).otherwise(0)).alias("_h")).agg(F.avg("_h").alias("recall"))


def average_precision(hits: DataFrame, by: str, relevant: str, total: str) -> DataFrame:
    """Per query: precision at each relevant rank, summed, over min(relevant rows, retrieved rows)."""
    w = Window.partitionBy(by).orderBy("rank")
    seen = hits.withColumn("_p", F.when(F.col(relevant), F.sum(F.col(relevant).cast("int")).over(w) / F.col("rank")))
    return seen.groupBy(by).agg((F.sum(F.coalesce("_p", F.lit(0.0))) / F.greatest(F.least(F.max(total), F.count(F.lit(1))), F.lit(1))).alias("ap"))


def enrichment(df: DataFrame, cluster: str, field: str) -> DataFrame:
    """Per cluster: dominant value (ties: least), purity, log2 of purity over the value's global share."""
    counts = df.groupBy(cluster, field).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(cluster).orderBy(F.desc("_n"), field)
    top = counts.withColumn("n", F.sum("_n").over(Window.partitionBy(cluster))).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    share = df.groupBy(field).agg(F.count(F.lit(1)).alias("_g")).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_all"))))
    out = top.join(share, field)
    purity = F.col("_n") / F.col("n")
    return out.select(cluster, F.col(field).alias("dominant"), "n", purity.alias("purity"), F.log2(purity / (F.col("_g") / F.col("_all"))).alias("enrichment"))

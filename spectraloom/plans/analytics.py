"""Statistics, windows, peak lists and retrieval over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import peaks as P
from ..operators import metrics as M
from ..operators import windows as W
from .catalog import register, table

#: Orders as spectra; rows that are equal in all columns are one peak.
PEAKS = "(SELECT DISTINCT l_orderkey AS spectrum, l_extendedprice / 50 AS mz, l_quantity AS intensity, l_linenumber AS line FROM lineitem)"


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("spectrum"), (F.col("l_extendedprice") / 50).alias("mz"), F.col("l_quantity").alias("intensity"), F.col("l_linenumber").alias("line")).distinct()


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    sorted_peaks = F.array_sort(F.collect_list(F.struct("mz", "intensity", "line")))
    rows = peaks(spark, sf_dir).groupBy("spectrum").agg(sorted_peaks.alias("_p"))
    return rows.select("spectrum", F.transform("_p", lambda p: p["mz"]).alias("mz"), F.transform("_p", lambda p: p["intensity"]).alias("intensity"))


@register("f1_distinct_keys", "SELECT DISTINCT replace(p_name, 'i', 'l') AS key FROM part WHERE p_size > 5")
def f1(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size > 5").select(F.translate("p_name", "i", "l").alias("key")).distinct()


@register("f2_max_mz", f"SELECT round(least(max(mz), 6000), 6) AS limit_mz FROM {PEAKS}")
def f2(spark, sf_dir):
    return spectra(spark, sf_dir).agg(F.round(F.least(F.max(F.array_max("mz")), F.lit(6000.0)), 6).alias("limit_mz"))


@register("f3_crosstab", "SELECT coalesce(o_orderstatus, '(null)') AS acquisition, coalesce(o_custkey % 8, -1) AS charge, count(*) AS n FROM orders GROUP BY 1, 2")
def f3(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.coalesce("o_orderstatus", F.lit("(null)")).alias("acquisition"), F.coalesce(F.col("o_custkey") % 8, F.lit(-1)).alias("charge")).agg(F.count(F.lit(1)).alias("n"))


@register("f4_census", "SELECT o_orderstatus, count(*) AS n, count_if(o_custkey IS NULL)::BIGINT AS null_keys, count(DISTINCT (o_custkey, o_orderpriority)) AS distinct_keys, count_if(o_totalprice <= 200000)::BIGINT AS kept FROM orders GROUP BY 1")
def f4(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_custkey").isNull()).alias("null_keys"), F.countDistinct(F.struct("o_custkey", "o_orderpriority")).alias("distinct_keys"), F.count_if(F.col("o_totalprice") <= 200000).alias("kept"))


@register("f6_top_peptides", "SELECT l_partkey, count(*) AS n, max(l_extendedprice) AS score, max(l_tax) AS probability FROM lineitem GROUP BY 1 ORDER BY n DESC, score DESC, probability DESC, l_partkey LIMIT 50")
def f6(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("score"), F.max("l_tax").alias("probability"))
    return rows.orderBy(F.desc("n"), F.desc("score"), F.desc("probability"), "l_partkey").limit(50)


@register("f7_grouped_counts", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, count(DISTINCT l_suppkey) AS files FROM lineitem GROUP BY 1, 2, 3")
def f7(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("files"))


@register("f9_error_policies", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS errors, list_contains(list(o_orderstatus), 'P') AS partial FROM orders GROUP BY 1")
def f9(spark, sf_dir):
    kinds = F.array_sort(F.collect_set("o_orderstatus"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(kinds.alias("_k")).select("o_custkey", F.array_join("_k", ",").alias("errors"), F.array_contains("_k", "P").alias("partial"))


@register("f14_rates", """SELECT l_suppkey, count(*) AS n, round(100.0 * count_if(l_discount < 0.05) / count(*), 6) AS as_is, round(100.0 * count_if(l_discount < 0.05 AND l_returnflag = 'R') / nullif(count_if(l_returnflag = 'R'), 0), 6) AS subset FROM lineitem GROUP BY 1""")
def f14(spark, sf_dir):
    ok, sub = F.col("l_discount") < 0.05, F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if(ok) / F.count(F.lit(1)), 6).alias("as_is"), F.round(F.try_divide(100.0 * F.count_if(ok & sub), F.count_if(sub)), 6).alias("subset"))


@register("f17_unpivot_errors", "SELECT 'zero' AS error, count_if(l_discount = 0)::BIGINT AS n FROM lineitem UNION ALL SELECT 'high', count_if(l_discount > 0.08)::BIGINT FROM lineitem UNION ALL SELECT 'null', count_if(l_discount IS NULL)::BIGINT FROM lineitem")
def f17(spark, sf_dir):
    d = F.col("l_discount")
    one = table(spark, sf_dir, "lineitem").agg(F.count_if(d == 0).alias("zero"), F.count_if(d > 0.08).alias("high"), F.count_if(d.isNull()).alias("null"))
    return one.unpivot([], ["zero", "high", "null"], "error", "n")


@register("f18_describe", """SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, round(quantile_cont(l_extendedprice, 0.05), 4) AS p5, round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
  round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS iqr, round(stddev_pop(l_extendedprice) / avg(l_extendedprice), 6) AS cv FROM lineitem GROUP BY 1 HAVING count(*) >= 10""")
def f18(spark, sf_dir):
    out = M.describe(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 10)
    return out.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "p5", "median", "iqr")], F.round("cv", 6).alias("cv"))


@register("f19_cross_strata", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(quantile_cont(l_quantity, 0.5), 4) AS median, round(stddev_pop(l_quantity), 4) AS std FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 10")
def f19(spark, sf_dir):
    return M.describe(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", 10).select("l_returnflag", "l_linestatus", "n", F.round("median", 4).alias("median"), F.round("std", 4).alias("std"))


@register("f20_spectrum_stats", f"SELECT spectrum, count(*) AS n, round(sum(intensity), 6) AS total, round(max(intensity) / (min(intensity) + 1e-10), 6) AS dynamic_range FROM {PEAKS} GROUP BY 1")
def f20(spark, sf_dir):
    i = F.col("intensity")
    return spectra(spark, sf_dir).select("spectrum", F.size(i).cast("long").alias("n"), F.round(P.total(i), 6).alias("total"), F.round(F.array_max(i) / (F.array_min(i) + 1e-10), 6).alias("dynamic_range"))


@register("f21_categorical", "SELECT o_orderpriority, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 6) AS percent FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def f21(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    counts = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    n = orders.agg(F.count(F.lit(1)).alias("_t"))
    return counts.orderBy(F.desc("n"), "o_orderpriority").limit(3).crossJoin(F.broadcast(n)).select("o_orderpriority", "n", F.round(100.0 * F.col("n") / F.col("_t"), 6).alias("percent"))


@register("f25_bin_jumps", """WITH c AS (SELECT l_partkey, floor(l_extendedprice / 5000)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT l_partkey, sum(n) AS total, max(n) AS top FROM c GROUP BY 1 HAVING sum(n) >= 5)
  SELECT count(*) AS ions, round(avg(1 - top / total), 9) AS jump_rate FROM t""")
def f25(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey", P.fixed_bin(F.col("l_extendedprice"), 5000.0).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy("l_partkey").agg(F.sum("n").alias("total"), F.max("n").alias("top")).filter("total >= 5")
    return tops.agg(F.count(F.lit(1)).alias("ions"), F.round(F.avg(1 - F.col("top") / F.col("total")), 9).alias("jump_rate"))


@register("f27_collisions", f"SELECT round(avg(share), 9) AS mean_share, round(quantile_cont(share, 0.95), 9) AS p95 FROM (SELECT spectrum, sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) AS share FROM (SELECT spectrum, floor(mz / 200) AS b, count(*) AS n FROM {PEAKS} GROUP BY 1, 2) GROUP BY 1)")
def f27(spark, sf_dir):
    cells = peaks(spark, sf_dir).groupBy("spectrum", P.fixed_bin(F.col("mz"), 200.0).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    share = cells.groupBy("spectrum").agg((F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    return share.agg(F.round(F.avg("share"), 9).alias("mean_share"), F.round(F.percentile("share", 0.95), 9).alias("p95"))


@register("f28_pareto", "SELECT p.p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_size <= p.p_size AND q.p_retailprice <= p.p_retailprice AND (q.p_size < p.p_size OR q.p_retailprice < p.p_retailprice))")
def f28(spark, sf_dir):
    # the least price among smaller or equal sizes decides: no pairs are needed
    part = table(spark, sf_dir, "part")
    best = part.groupBy("p_brand", "p_size").agg(F.min("p_retailprice").alias("_m"))
    before = Window.partitionBy("p_brand").orderBy("p_size").rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_b", F.min("_m").over(before))
    return part.join(best, ["p_brand", "p_size"]).filter((F.col("p_retailprice") == F.col("_m")) & (F.col("_b").isNull() | (F.col("_b") > F.col("p_retailprice")))).select("p_partkey")


@register("f29_entropy", "SELECT round(-sum(n / t * log2(n / t)), 9) AS bits FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM lineitem GROUP BY floor(l_extendedprice / 1000))")
def f29(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(P.fixed_bin(F.col("l_extendedprice"), 1000.0).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.round(F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"), 9).alias("bits"))


@register("f41_enrichment", """WITH c AS (SELECT c_mktsegment AS cluster, c_nationkey, count(*) AS k FROM customer GROUP BY 1, 2), t AS (SELECT *, sum(k) OVER (PARTITION BY cluster)::BIGINT AS n, row_number() OVER (PARTITION BY cluster ORDER BY k DESC, c_nationkey) AS r FROM c)
  SELECT cluster, t.c_nationkey AS dominant, n, round(k / n, 9) AS purity, round(log2(k / n / (SELECT count(*) FROM customer x WHERE x.c_nationkey = t.c_nationkey) * (SELECT count(*) FROM customer)), 6) AS enrichment FROM t WHERE r = 1""")
def f41(spark, sf_dir):
    out = M.enrichment(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "cluster"), "cluster", "c_nationkey")
    return out.withColumn("purity", F.round("purity", 9)).withColumn("enrichment", F.round("enrichment", 6))


@register("f44_ece", """SELECT round(sum(n * abs(a - c)) / (SELECT count(*) FROM lineitem), 9) AS ece FROM (SELECT ceil(l_discount * 10 * 15) AS b, count(*) AS n, avg(l_discount * 10) AS c, avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) AS a FROM lineitem WHERE l_discount * 10 > 0 AND ceil(l_discount * 10 * 15) <= 15 GROUP BY 1)""")
def f44(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("c"), "l_returnflag")
    return M.expected_calibration_error(rows, "c", F.col("l_returnflag") == "N").select(F.round("ece", 9).alias("ece"))


@register("f45_mz_errors", "SELECT round(avg(abs(e)), 9) AS mae, round(sqrt(avg(e * e)), 9) AS rmse, round(avg(CASE WHEN abs(e) <= 0.02 THEN 1.0 ELSE 0.0 END), 9) AS within, round(quantile_cont(abs(e), 0.5), 9) AS median FROM (SELECT l_discount - l_tax AS e FROM lineitem)")
def f45(spark, sf_dir):
    e = F.col("l_discount") - F.col("l_tax")
    return table(spark, sf_dir, "lineitem").agg(F.round(F.avg(F.abs(e)), 9).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 9).alias("rmse"), F.round(F.avg((F.abs(e) <= 0.02).cast("double")), 9).alias("within"), F.round(F.percentile(F.abs(e), 0.5), 9).alias("median"))


@register("f55_auroc", """WITH r AS (SELECT l_returnflag = 'R' AS p, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS k FROM lineitem)
  SELECT round((sum(k) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2.0) / (count(*) FILTER (p) * count(*) FILTER (NOT p)), 9) AS auroc FROM r""")
def f55(spark, sf_dir):
    return M.auroc(table(spark, sf_dir, "lineitem"), "l_discount", F.col("l_returnflag") == "R").select(F.round("auroc", 9).alias("auroc"))


@register("f57_paired_auroc", """WITH g AS (SELECT a.l_suppkey, avg(CASE WHEN a.l_quantity > b.l_quantity THEN 1.0 WHEN a.l_quantity = b.l_quantity THEN 0.5 ELSE 0.0 END) AS auroc FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey WHERE a.l_returnflag = 'R' AND b.l_returnflag <> 'R' GROUP BY 1)
  SELECT count(*) AS n, round(avg(auroc), 6) AS macro FROM g""")
def f57(spark, sf_dir):
    return M.auroc(table(spark, sf_dir, "lineitem"), "l_quantity", F.col("l_returnflag") == "R", ["l_suppkey"]).filter("auroc IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("auroc"), 6).alias("macro"))


@register("g8_capped_sample", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('42:' || event_id::VARCHAR), event_id) AS r FROM events) WHERE r <= 2")
def g8(spark, sf_dir):
    order = [F.md5(F.concat(F.lit("42:"), F.col("event_id").cast("string"))), F.col("event_id")]
    return W.top_per_group(table(spark, sf_dir, "events"), ["user_id"], order, 2).select("user_id", "event_id")


@register("g10_spans", f"""WITH f AS (SELECT spectrum, mz, line, intensity, intensity > 25 AS m, row_number() OVER (PARTITION BY spectrum ORDER BY mz, line, intensity) - row_number() OVER (PARTITION BY spectrum, intensity > 25 ORDER BY mz, line, intensity) AS i FROM {PEAKS})
  SELECT len, count(*) AS n FROM (SELECT count(*) AS len FROM f WHERE m GROUP BY spectrum, i) GROUP BY 1""")
def g10(spark, sf_dir):
    runs = W.islands(peaks(spark, sf_dir), ["spectrum"], ["mz", "line", "intensity"], F.col("intensity") > 25)
    return runs.groupBy("spectrum", "island").agg(F.count(F.lit(1)).alias("len")).groupBy("len").agg(F.count(F.lit(1)).alias("n"))


@register("g11_longest_run", "SELECT l_orderkey, max(n) AS longest FROM (SELECT l_orderkey, i, count(*) AS n FROM (SELECT l_orderkey, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) GROUP BY 1, 2) GROUP BY 1")
def g11(spark, sf_dir):
    return W.longest_run(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@register("e14_nearest_gaps", f"""WITH w AS (SELECT spectrum, mz, intensity, line, last_value(CASE WHEN intensity <= 25 THEN mz END IGNORE NULLS) OVER (PARTITION BY spectrum ORDER BY mz, intensity, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
    first_value(CASE WHEN intensity <= 25 THEN mz END IGNORE NULLS) OVER (PARTITION BY spectrum ORDER BY mz, intensity, line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM {PEAKS})
  SELECT count(*) AS n, round(avg(mz - l), 6) AS left_gap, round(avg(r - mz), 6) AS right_gap, round(avg(least(mz - l, r - mz)), 6) AS nearest FROM w WHERE intensity > 25""")
def e14(spark, sf_dir):
    rows = W.nearest_gaps(peaks(spark, sf_dir), ["spectrum"], "mz", F.col("intensity") > 25, F.col("intensity") <= 25)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("left_gap"), 6).alias("left_gap"), F.round(F.avg("right_gap"), 6).alias("right_gap"), F.round(F.avg("nearest_gap"), 6).alias("nearest"))


@register("e17_band_join", f"SELECT count(*) AS pairs, round(avg(abs(a.mz - b.mz)), 6) AS mean_gap FROM {PEAKS} a JOIN {PEAKS} b ON a.spectrum = b.spectrum AND a.line < b.line AND abs(a.mz - b.mz) <= 30")
def e17(spark, sf_dir):
    rows = peaks(spark, sf_dir).select("spectrum", "mz", "line")
    other = rows.select("spectrum", F.col("mz").alias("mz_b"), F.col("line").alias("line_b"))
    found = W.band_join(rows, other, ["spectrum"], "mz", "mz_b", 30.0).filter("line < line_b")
    return found.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.abs(F.col("mz") - F.col("mz_b"))), 6).alias("mean_gap"))


@register("k1_process_spectrum", f"""WITH p AS (SELECT spectrum, mz, intensity, max(intensity) OVER (PARTITION BY spectrum) AS most FROM {PEAKS} WHERE mz BETWEEN 50 AND 2500 AND abs(mz - 500) > 2)
  SELECT spectrum, count(*) AS n, round(sum(sqrt(intensity)) / sqrt(sum(intensity)), 6) AS total FROM p WHERE intensity >= 0.1 * most GROUP BY 1""")
def k1(spark, sf_dir):
    out = spectra(spark, sf_dir).select("spectrum", P.process(F.col("mz"), F.col("intensity"), F.lit(500.0), relative=0.1).alias("p")).filter(F.size("p") > 0)
    return out.select("spectrum", F.size("p").cast("long").alias("n"), F.round(P.total(F.transform("p", lambda x: x["intensity"])), 6).alias("total"))


@register("k4_binned", f"SELECT spectrum, floor(mz / 100)::BIGINT AS bin, round(sum(intensity), 6) AS intensity FROM {PEAKS} WHERE mz < 1500 GROUP BY 1, 2")
def k4(spark, sf_dir):
    return peaks(spark, sf_dir).filter("mz < 1500").groupBy("spectrum", P.fixed_bin(F.col("mz"), 100.0).alias("bin")).agg(F.round(F.sum("intensity"), 6).alias("intensity"))


@register("k12_max_normalised", f"SELECT spectrum, round(sum(intensity / m), 6) AS total FROM (SELECT spectrum, intensity, max(intensity) OVER (PARTITION BY spectrum) AS m FROM {PEAKS}) GROUP BY 1")
def k12(spark, sf_dir):
    return spectra(spark, sf_dir).select("spectrum", F.round(P.total(P.max_normalise(F.col("intensity"))), 6).alias("total"))


@register("k13_ppm_bins", "SELECT floor(ln(l_extendedprice / 50.0) / ln(1 + 5e4 * 1e-6))::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1")
def k13(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_extendedprice > 0").groupBy(P.ppm_bin(F.col("l_extendedprice"), 5e4).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@register("k14_mu_law", "SELECT round(sum(sign(x) * ln(1 + 255 * abs(x)) / ln(256)), 6) AS encoded, round(sum(x), 6) AS decoded FROM (SELECT l_discount - l_tax AS x FROM lineitem)")
def k14(spark, sf_dir):
    x = F.col("l_discount") - F.col("l_tax")
    return table(spark, sf_dir, "lineitem").agg(F.round(F.sum(P.mu_law(x, 255.0)), 6).alias("encoded"), F.round(F.sum(P.mu_law_inverse(P.mu_law(x, 255.0), 255.0)), 6).alias("decoded"))


KNN = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS q, b.vec_id AS l, a.label = b.label AS same, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 9) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, l) AS rank FROM s QUALIFY rank <= 10)"""


def neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    hits = M.cosine_top_k(rows.filter("id % 50 = 0"), rows, 10)
    labels = rows.select("id", "label")
    hits = hits.join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("_q")), "query_id").join(labels.select(F.col("id").alias("library_id"), F.col("label").alias("_l")), "library_id")
    return hits.withColumn("same", F.col("_q") == F.col("_l"))


@register("h1_top_k", f"{KNN} SELECT q AS query_id, count(*) AS n, round(max(score), 6) AS best, round(min(score), 6) AS least FROM r GROUP BY 1")
def h1(spark, sf_dir):
    return neighbours(spark, sf_dir).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("best"), F.round(F.min("score"), 6).alias("least"))


@register("g4_recall", f"{KNN} SELECT round(avg(h), 9) AS recall FROM (SELECT max(CASE WHEN same AND rank <= 5 THEN 1.0 ELSE 0.0 END) AS h FROM r GROUP BY q)")
def g4(spark, sf_dir):
    return M.recall_at(neighbours(spark, sf_dir), "query_id", F.col("same"), 5).select(F.round("recall", 9).alias("recall"))


@register("g5_average_precision", f"""{KNN}, t AS (SELECT q, count_if(same) AS total FROM s GROUP BY 1), h AS (SELECT r.q, same, rank, sum(same::INT) OVER (PARTITION BY r.q ORDER BY rank) AS hits FROM r)
  SELECT round(avg(ap), 9) AS map FROM (SELECT h.q, sum(CASE WHEN same THEN hits / rank ELSE 0.0 END) / greatest(least(max(total), count(*)), 1) AS ap FROM h JOIN t USING (q) GROUP BY 1)""")
def g5(spark, sf_dir):
    totals = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("_q")).agg((F.count(F.lit(1)) - 1).alias("total"))
    return M.average_precision(neighbours(spark, sf_dir).join(totals, "_q"), "query_id", "same", "total").agg(F.round(F.avg("ap"), 9).alias("map"))


@register("g6_margins", f"{KNN} SELECT q AS query_id, round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 6) AS margin FROM r GROUP BY 1")
def g6(spark, sf_dir):
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    return neighbours(spark, sf_dir).groupBy("query_id").agg(F.round(at(1) - at(2), 6).alias("margin"))


@register("f51_embedding_stats", "SELECT count(*) AS n, max(len(embedding))::INT AS dim, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS norm_mean FROM embeddings")
def f51(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim"), F.round(F.avg(P.norm(v)), 6).alias("norm_mean"))

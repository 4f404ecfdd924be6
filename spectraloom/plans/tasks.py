"""Statistics, selections, probes and retrieval tasks over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import peaks as P
from ..operators import metrics as M
from ..operators import probes as O
from ..operators import splits
from ..operators.rank import tiers
from .analytics import KNN, neighbours
from .catalog import register, table
from .tiers import SCORED, scored

ROUND = lambda c, n=6: F.round(c, n)
RANK = "rank() OVER (PARTITION BY {g} ORDER BY {x}) + (count(*) OVER (PARTITION BY {g}, {x}) - 1) / 2.0"


@register("f8_top_queries", "SELECT user_id, score, margin FROM (SELECT user_id, max(value) AS score, arg_min(value, event_id) AS margin, row_number() OVER (ORDER BY max(value) DESC, user_id) AS r FROM events WHERE value IS NOT NULL GROUP BY 1) WHERE r <= 25")
def f8(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("value IS NOT NULL").groupBy("user_id").agg(F.max("value").alias("score"), F.min_by("value", "event_id").alias("margin"))
    return rows.orderBy(F.desc("score"), "user_id").limit(25)


@register("f22_numeric_profile", "SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, round(100.0 * count_if(o_totalprice IS NULL) / count(*), 6) AS null_percent, avg(o_totalprice) > 100000 AS warn FROM orders")
def f22(spark, sf_dir):
    x = F.col("o_totalprice")
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))
    rows = table(spark, sf_dir, "orders").agg(F.count(x).alias("n"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"), q.alias("_q"), (100.0 * F.count_if(x.isNull()) / F.count(F.lit(1))).alias("_p"))
    return rows.select("n", ROUND("_m", 4).alias("mean"), ROUND("_s", 4).alias("std"), ROUND(F.col("_q")[0], 4).alias("q1"), ROUND(F.col("_q")[1], 4).alias("q3"), ROUND("_p").alias("null_percent"), (F.col("_m") > 100000).alias("warn"))


@register("f23_range_errors", "SELECT floor(l_extendedprice / 20000)::BIGINT AS range, count(*) AS n, round(avg(l_discount - l_tax), 6) AS mean, round(stddev_samp(l_discount - l_tax), 6) AS std FROM lineitem GROUP BY 1")
def f23(spark, sf_dir):
    e = F.col("l_discount") - F.col("l_tax")
    return table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_extendedprice") / 20000).alias("range")).agg(F.count(F.lit(1)).alias("n"), ROUND(F.avg(e)).alias("mean"), ROUND(F.stddev_samp(e)).alias("std"))


@register("f24_bin_strategies", "SELECT w AS width, round(avg((floor(l_extendedprice / w) <> floor((l_extendedprice + l_tax * 100) / w))::INT), 6) AS moved, round(avg(abs(l_extendedprice / w - floor(l_extendedprice / w) - 0.5)), 6) AS residual FROM lineitem, (VALUES (10), (50), (200)) s(w) GROUP BY 1")
def f24(spark, sf_dir):
    x, y = F.col("l_extendedprice"), F.col("l_extendedprice") + F.col("l_tax") * 100
    aggs = []
    for w in (10, 50, 200):
        aggs.append(F.struct(F.lit(w).alias("width"), ROUND(F.avg((F.floor(x / w) != F.floor(y / w)).cast("int"))).alias("moved"), ROUND(F.avg(F.abs(x / w - F.floor(x / w) - 0.5))).alias("residual")).alias(f"_{w}"))
    return table(spark, sf_dir, "lineitem").agg(*aggs).select(F.explode(F.array("_10", "_50", "_200")).alias("_s")).select("_s.*")


@register("f26_jump_distances", """WITH c AS (SELECT l_partkey, floor(l_extendedprice / 5000)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT l_partkey, arg_min(bin, (-n, bin)) AS modal FROM c GROUP BY 1)
  SELECT l_partkey, round(sum(abs(bin - modal) * n) / sum(n), 6) AS mean, sum(n)::BIGINT AS jumps FROM c JOIN m USING (l_partkey) WHERE bin <> modal GROUP BY 1""")
def f26(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").groupBy("l_partkey", P.fixed_bin(F.col("l_extendedprice"), 5000.0).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    modal = cells.groupBy("l_partkey").agg(F.min_by("bin", F.struct(-F.col("n"), "bin")).alias("modal"))
    far = cells.join(modal, "l_partkey").filter("bin <> modal")
    return far.groupBy("l_partkey").agg(ROUND(F.sum(F.abs(F.col("bin") - F.col("modal")) * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("jumps"))


@register("f31_error_percentiles", "SELECT least(floor((l_extendedprice - low) / (high - low) * 12), 11)::BIGINT AS bin, count(*) AS n, round(quantile_cont(abs(l_discount - l_tax), 0.95), 6) AS p95 FROM lineitem, (SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem) GROUP BY 1 HAVING count(*) >= 5")
def f31(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    span = rows.agg(F.min("l_extendedprice").alias("_l"), F.max("l_extendedprice").alias("_h"))
    b = F.least(F.floor((F.col("l_extendedprice") - F.col("_l")) / (F.col("_h") - F.col("_l")) * 12), F.lit(11)).cast("long")
    out = rows.crossJoin(F.broadcast(span)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), ROUND(F.percentile(F.abs(F.col("l_discount") - F.col("l_tax")), 0.95)).alias("p95"))
    return out.filter("n >= 5")


@register("f32_stratified_jumps", """WITH c AS (SELECT l_returnflag, l_partkey, floor(l_extendedprice / 5000) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), t AS (SELECT l_returnflag, l_partkey, 1 - max(n) / sum(n) AS jump, sum(n) AS total FROM c GROUP BY 1, 2)
  SELECT l_returnflag, round(avg(jump), 9) AS jump, round(0.5 * avg(jump) + 0.5 * avg((total > 10)::INT), 9) AS score FROM t GROUP BY 1""")
def f32(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_partkey", P.fixed_bin(F.col("l_extendedprice"), 5000.0).alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    ions = cells.groupBy("l_returnflag", "l_partkey").agg((1 - F.max("n") / F.sum("n")).alias("_j"), F.sum("n").alias("_t"))
    return ions.groupBy("l_returnflag").agg(ROUND(F.avg("_j"), 9).alias("jump"), ROUND(0.5 * F.avg("_j") + 0.5 * F.avg((F.col("_t") > 10).cast("int")), 9).alias("score"))


@register("f36_coverage", "SELECT l_linestatus, floor(l_extendedprice / 25000)::BIGINT AS range, count_if(l_discount < 0.05)::BIGINT AS matched, round(count_if(l_discount < 0.05) / count(*), 6) AS coverage FROM lineitem GROUP BY 1, 2")
def f36(spark, sf_dir):
    hit = F.count_if(F.col("l_discount") < 0.05)
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus", F.floor(F.col("l_extendedprice") / 25000).alias("range")).agg(hit.alias("matched"), ROUND(hit / F.count(F.lit(1))).alias("coverage"))


@register("f37_mass_errors", "SELECT l_returnflag, round(avg(e), 9) AS mean, round(stddev_pop(e), 9) AS std, round(avg(e) / (stddev_samp(e) / sqrt(count(*))), 4) AS t FROM (SELECT l_returnflag, l_discount - l_tax AS e FROM lineitem) GROUP BY 1")
def f37(spark, sf_dir):
    e = F.col("l_discount") - F.col("l_tax")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(ROUND(F.avg(e), 9).alias("mean"), ROUND(F.stddev_pop(e), 9).alias("std"), ROUND(F.avg(e) / (F.stddev_samp(e) / F.sqrt(F.count(F.lit(1)))), 4).alias("t"))


@register("f40_quality_gate", """WITH r AS (SELECT l_returnflag, l_linestatus, l_quantity < 10 AS bad FROM lineitem), a AS (SELECT avg(bad::INT) AS rate FROM r)
  SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(bad::INT), 6) AS rate, round(avg(bad::INT) / max(rate), 6) AS risk FROM r, a GROUP BY CUBE (l_returnflag, l_linestatus)""")
def f40(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_quantity") < 10).cast("int").alias("_b"))
    cells = rows.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.avg("_b").alias("_r"))
    return cells.crossJoin(F.broadcast(rows.agg(F.avg("_b").alias("_a")))).select("l_returnflag", "l_linestatus", "n", ROUND("_r").alias("rate"), ROUND(F.col("_r") / F.col("_a")).alias("risk"))


@register("f42_mutual_information", """WITH c AS (SELECT c_mktsegment AS a, c_nationkey AS b, count(*) AS n FROM customer GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c), h AS (SELECT (SELECT -sum(x / t * ln(x / t)) FROM (SELECT sum(n) AS x FROM c GROUP BY a), t) AS ha, (SELECT -sum(x / t * ln(x / t)) FROM (SELECT sum(n) AS x FROM c GROUP BY b), t) AS hb, (SELECT -sum(n / t * ln(n / t)) FROM c, t) AS hj)
  SELECT round(2 * (ha + hb - hj) / (ha + hb), 6) AS nmi FROM h""")
def f42(spark, sf_dir):
    return O.normalised_mutual_information(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey").select(ROUND("nmi").alias("nmi"))


@register("f43_pooled_runs", """WITH e AS (SELECT label, vec_id % 3 AS w, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings), m AS (SELECT label, place, CASE WHEN sum(w) > 0 THEN sum(w * v) / sum(w) ELSE avg(v) END AS x FROM e GROUP BY 1, 2)
  SELECT label, place::INT AS place, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) AS value FROM m""")
def f43(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return O.pooled(rows, "label", "v", (F.col("vec_id") % 3).cast("double")).select("label", "place", ROUND("value", 5).alias("value"))


@register("f47_running_stats", "SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def f47(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("value").alias("n"), ROUND(F.avg("value")).alias("mean"), ROUND(F.var_samp("value")).alias("variance"), F.min("value").alias("least"), F.max("value").alias("most"))


@register("f48_spearman", f"SELECT l_suppkey, count(*) AS n, round(corr(a, b), 6) AS spearman FROM (SELECT l_suppkey, {RANK.format(g='l_suppkey', x='l_quantity')} AS a, {RANK.format(g='l_suppkey', x='l_extendedprice')} AS b FROM lineitem) GROUP BY 1")
def f48(spark, sf_dir):
    out = O.spearman(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return out.select("l_suppkey", "n", ROUND("spearman").alias("spearman"))


@register("f50_cliffs_delta", """WITH r AS (SELECT l_suppkey, l_returnflag = 'R' AS p, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS k FROM lineitem)
  SELECT l_suppkey, round(2 * (sum(k) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2.0) / (count(*) FILTER (p) * count(*) FILTER (NOT p)) - 1, 6) AS delta FROM r GROUP BY 1""")
def f50(spark, sf_dir):
    return O.cliffs_delta(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", F.col("l_returnflag") == "R").select("l_suppkey", ROUND("delta").alias("delta"))


@register("f52_selectors", "SELECT selector, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median FROM (SELECT o_orderpriority AS selector, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_totalprice IS NOT NULL) WHERE r <= 50 GROUP BY 1")
def f52(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = table(spark, sf_dir, "orders").filter("o_totalprice IS NOT NULL").withColumn("_r", F.row_number().over(w)).filter("_r <= 50")
    return top.groupBy(F.col("o_orderpriority").alias("selector")).agg(F.count(F.lit(1)).alias("n"), ROUND(F.avg("o_totalprice"), 4).alias("mean"), ROUND(F.percentile("o_totalprice", 0.5), 4).alias("median"))


@register("f53_modification_class", "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'Unmodified' WHEN r <= 3 THEN p_brand ELSE 'Other' END AS class FROM part JOIN (SELECT p_brand AS b, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part WHERE p_size % 10 <> 0 GROUP BY 1) ON b = p_brand")
def f53(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    top = part.filter("p_size % 10 <> 0").groupBy("p_brand").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "p_brand").limit(3).select("p_brand", F.lit(True).alias("_t"))
    kind = F.when(F.col("p_size") % 10 == 0, "Unmodified").when(F.col("_t"), F.col("p_brand")).otherwise("Other")
    return part.join(F.broadcast(top), "p_brand", "left").select("p_partkey", kind.alias("class"))


@register("f56_group_means", "SELECT l_linestatus, l_linenumber, least(floor(l_quantity / 10), 4)::BIGINT AS bin, round(avg(l_discount), 6) AS mean, round(corr(l_discount, l_quantity), 5) AS r FROM lineitem GROUP BY 1, 2, 3")
def f56(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_linenumber", F.least(F.floor(F.col("l_quantity") / 10), F.lit(4)).cast("long").alias("bin")).agg(ROUND(F.avg("l_discount")).alias("mean"), ROUND(F.corr("l_discount", "l_quantity"), 5).alias("r"))


@register("f58_project_index", "SELECT o_custkey, count_if(o_orderstatus = 'F')::BIGINT AS train, count_if(o_orderstatus = 'O')::BIGINT AS valid, count_if(o_orderstatus = 'P')::BIGINT AS test FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1 HAVING count(*) >= 5")
def f58(spark, sf_dir):
    cells = table(spark, sf_dir, "orders").filter("o_totalprice IS NOT NULL").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)
    return cells.filter("F + O + P >= 5").select("o_custkey", F.col("F").alias("train"), F.col("O").alias("valid"), F.col("P").alias("test"))


@register("f61_similarities", f"{KNN} SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(ln(avg(exp(-2 * (2 - 2 * score)))), 6) AS uniformity FROM r")
def f61(spark, sf_dir):
    out = O.uniformity(neighbours(spark, sf_dir), "score")
    return out.select(*[ROUND(c).alias(c) for c in ("mean", "std", "uniformity")])


@register("f63_metric_summary", "SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS least, max(v) AS most FROM (SELECT l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem) UNPIVOT (v FOR metric IN (quantity, discount, tax)) WHERE isfinite(v) GROUP BY 1")
def f63(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax")).unpivot([], ["quantity", "discount", "tax"], "metric", "v")
    finite = rows.filter("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')")
    return finite.groupBy("metric").agg(ROUND(F.avg("v")).alias("mean"), ROUND(F.stddev_pop("v")).alias("std"), F.min("v").alias("least"), F.max("v").alias("most"))


@register("f64_seed_summary", "SELECT metric, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM (SELECT event_type AS metric, event_id % 5 AS seed, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def f64(spark, sf_dir):
    seeds = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), (F.col("event_id") % 5).alias("_s")).agg(F.avg("value").alias("_m"))
    return seeds.groupBy("metric").agg(ROUND(F.avg("_m")).alias("mean"), ROUND(F.stddev_pop("_m")).alias("std"))


@register("f55b_separation", """WITH c AS (SELECT l_linenumber, l_discount, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1, 2),
  g AS (SELECT l_linenumber, abs(sum(p) OVER w / sum(p) OVER (PARTITION BY l_linenumber) - sum(n) OVER w / sum(n) OVER (PARTITION BY l_linenumber)) AS g FROM c WINDOW w AS (PARTITION BY l_linenumber ORDER BY l_discount)),
  d AS (SELECT l_linenumber, avg(l_discount) FILTER (l_returnflag = 'R') AS m1, avg(l_discount) FILTER (l_returnflag <> 'R') AS m0, var_samp(l_discount) FILTER (l_returnflag = 'R') AS v1, var_samp(l_discount) FILTER (l_returnflag <> 'R') AS v0, count(*) FILTER (l_returnflag = 'R') AS c1, count(*) FILTER (l_returnflag <> 'R') AS c0 FROM lineitem GROUP BY 1)
  SELECT d.l_linenumber, round(max(g), 6) AS ks, round(any_value((m1 - m0) / sqrt(((c1 - 1) * v1 + (c0 - 1) * v0) / (c1 + c0 - 2))), 6) AS cohens_d FROM g JOIN d USING (l_linenumber) GROUP BY 1""")
def f55b(spark, sf_dir):
    out = O.ks_distance(table(spark, sf_dir, "lineitem"), ["l_linenumber"], "l_discount", F.col("l_returnflag") == "R")
    return out.select("l_linenumber", ROUND("ks").alias("ks"), ROUND("cohens_d").alias("cohens_d"))


@register("g3_filtered_tier", f"WITH s AS ({SCORED}), q AS (SELECT quantile_cont(score, 0.98) AS h FROM s) SELECT l_linenumber, count(*) AS n, round(min(score), 6) AS least FROM s, q WHERE score > h GROUP BY 1")
def g3(spark, sf_dir):
    high = tiers(scored(spark, sf_dir), weight="n").filter("tier = 'high'")
    return high.groupBy("l_linenumber").agg(F.sum("n").alias("n"), ROUND(F.min("score")).alias("least"))


@register("g9_per_raw_file", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('9:' || event_id::VARCHAR), event_id) AS r FROM events) WHERE r <= 3")
def g9(spark, sf_dir):
    return O.seeded_sample(table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], "event_id", 3, 9)


@register("g12_query_pool", "SELECT user_id, event_id FROM (SELECT user_id, arg_min(event_id, (value, event_id)) AS event_id FROM events WHERE value IS NOT NULL GROUP BY 1) ORDER BY md5('42:' || user_id::VARCHAR), user_id LIMIT 50")
def g12(spark, sf_dir):
    first = table(spark, sf_dir, "events").filter("value IS NOT NULL").groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("event_id"))
    return first.orderBy(splits.order_hash(F.col("user_id")), "user_id").limit(50)


@register("h2_similar", f"{KNN} SELECT q AS query_id, l AS library_id, round(score, 6) AS score FROM r WHERE rank = 1")
def h2(spark, sf_dir):
    return neighbours(spark, sf_dir).filter("rank = 1").select("query_id", "library_id", ROUND("score").alias("score"))


@register("h3_label_retrieval", f"{KNN} SELECT q AS query_id, count_if(same AND rank <= 5)::BIGINT AS hits, min(CASE WHEN same THEN rank END)::INT AS first_hit FROM r GROUP BY 1")
def h3(spark, sf_dir):
    return neighbours(spark, sf_dir).groupBy("query_id").agg(F.count_if(F.col("same") & (F.col("rank") <= 5)).alias("hits"), F.min(F.when(F.col("same"), F.col("rank"))).alias("first_hit"))


@register("h4_ranked_pairs", "SELECT l_suppkey, l_partkey, mods, base FROM (SELECT l_suppkey, l_partkey, count_if(l_returnflag <> 'N')::BIGINT AS mods, count_if(l_returnflag = 'N')::BIGINT AS base, row_number() OVER (PARTITION BY l_suppkey ORDER BY count_if(l_returnflag <> 'N') DESC, count_if(l_returnflag = 'N') DESC, l_partkey) AS r FROM lineitem GROUP BY 1, 2) WHERE r <= 3")
def h4(spark, sf_dir):
    new = F.col("l_returnflag") == "N"
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count_if(~new).alias("mods"), F.count_if(new).alias("base"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("mods"), F.desc("base"), "l_partkey")
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r <= 3").drop("_r")


@register("i4_batch_registry", """WITH b AS (SELECT DISTINCT p_name AS key FROM part), h AS (SELECT DISTINCT 'old' || (o_custkey % 60)::VARCHAR AS key, 'train' AS split FROM orders), f AS (SELECT count(*) AS n FROM b), r AS (SELECT key, row_number() OVER (ORDER BY md5('42:' || key), key) - 1 AS r FROM b)
  SELECT key, split FROM h UNION ALL SELECT key, CASE WHEN r < round(n * 0.8) THEN 'train' WHEN r < round(n * 0.8) + round(n * 0.1) THEN 'val' ELSE 'test' END FROM r, f""")
def i4(spark, sf_dir):
    batch = table(spark, sf_dir, "part").select(F.col("p_name").alias("key")).distinct()
    history = table(spark, sf_dir, "orders").select(F.concat(F.lit("old"), (F.col("o_custkey") % 60).cast("string")).alias("key")).distinct().withColumn("split", F.lit("train"))
    return splits.merge_history(splits.assign_hashes(batch, history, "key"), history, "key")


@register("i6_project_disjoint", """WITH s AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT sum(n) * 0.1 AS g FROM s), c AS (SELECT l_suppkey, n, g, coalesce(sum(least(n, g * 0.5)) OVER (ORDER BY n DESC, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s, t)
  SELECT l_suppkey, n, CASE WHEN b < g THEN 'val' WHEN b < 2 * g THEN 'test' ELSE 'train' END AS split FROM c""")
def i6(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return O.project_disjoint(sizes, "l_suppkey", "n")


@register("i7_paired_backbones", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, f ORDER BY event_id) AS r, min(f) OVER (PARTITION BY user_id) AS a, max(f) OVER (PARTITION BY user_id) AS b FROM (SELECT event_id, user_id, (value > 50)::INT AS f FROM events WHERE value IS NOT NULL)) WHERE a = 0 AND b = 1 AND r <= 2")
def i7(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_id", "user_id", (F.col("value") > 50).cast("int").alias("f"))
    both = rows.groupBy("user_id").agg(F.min("f").alias("_a"), F.max("f").alias("_b")).filter("_a = 0 AND _b = 1").select("user_id")
    ranked = rows.join(both, "user_id", "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy("user_id", "f").orderBy("event_id")))
    return ranked.filter("_r <= 2").select("event_id")


@register("l1_duplicate_groups", f"{KNN}, g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1 HAVING count(*) > 1) SELECT e.label, any_value(n) AS members, round(avg(h), 6) AS recall FROM (SELECT q, max((same AND rank <= 5)::INT) AS h FROM r GROUP BY 1) x JOIN embeddings e ON e.vec_id = x.q JOIN g ON g.label = e.label GROUP BY 1")
def l1(spark, sf_dir):
    groups = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    hits = neighbours(spark, sf_dir).groupBy("query_id", F.col("_q").alias("label")).agg(F.max((F.col("same") & (F.col("rank") <= 5)).cast("int")).alias("_h"))
    return hits.groupBy("label").agg(ROUND(F.avg("_h")).alias("recall")).join(groups, "label")


@register("l2_query_library", "SELECT l_partkey, min(l_orderkey) AS query, count(*) AS library FROM lineitem GROUP BY 1")
def l2(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_orderkey").alias("query"), F.count(F.lit(1)).alias("library"))


@register("l3_similarity_by_distance", f"{KNN} SELECT abs(b.label - a.label) AS distance, count(*) AS n, round(avg(score), 6) AS mean FROM r JOIN embeddings a ON a.vec_id = r.q JOIN embeddings b ON b.vec_id = r.l GROUP BY 1")
def l3(spark, sf_dir):
    rows = neighbours(spark, sf_dir).withColumn("distance", F.abs(F.col("_l") - F.col("_q")))
    return rows.groupBy("distance").agg(F.count(F.lit(1)).alias("n"), ROUND(F.avg("score")).alias("mean"))


@register("l4_cross_set_transfer", f"{KNN} SELECT q AS query_id, arg_min(l, rank) AS library_id, round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 6) AS margin FROM r GROUP BY 1")
def l4(spark, sf_dir):
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    return neighbours(spark, sf_dir).groupBy("query_id").agg(F.min_by("library_id", "rank").alias("library_id"), ROUND(at(1) - at(2)).alias("margin"))


@register("l5_query_metrics", f"{KNN} SELECT q AS query_id, min(rank) FILTER (same)::INT AS best_rank, round(max(score) FILTER (same), 6) AS best_positive, round(avg(score) FILTER (same), 6) AS mean_positive, round(max(score) FILTER (NOT same), 6) AS best_negative FROM r GROUP BY 1")
def l5(spark, sf_dir):
    yes, no = F.when(F.col("same"), F.col("score")), F.when(~F.col("same"), F.col("score"))
    return neighbours(spark, sf_dir).groupBy("query_id").agg(F.min(F.when(F.col("same"), F.col("rank"))).alias("best_rank"), ROUND(F.max(yes)).alias("best_positive"), ROUND(F.avg(yes)).alias("mean_positive"), ROUND(F.max(no)).alias("best_negative"))


@register("l9_balanced_weights", "SELECT o_orderkey, round(count(*) OVER () / (SELECT count(DISTINCT o_orderstatus) FROM orders WHERE o_orderstatus IS NOT NULL) / count(*) OVER (PARTITION BY o_orderstatus), 9) AS weight FROM orders WHERE o_orderstatus IS NOT NULL")
def l9(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus IS NOT NULL")
    classes = rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("_c"))
    facts = classes.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    weights = classes.crossJoin(F.broadcast(facts)).select("o_orderstatus", ROUND(F.col("_n") / F.col("_k") / F.col("_c"), 9).alias("weight"))
    return rows.join(F.broadcast(weights), "o_orderstatus").select("o_orderkey", "weight")


@register("l11_similarity_score_correlation", f"{KNN} SELECT round(corr(m, q), 6) AS r, count(*) AS n FROM (SELECT q, avg(score) AS m FROM r GROUP BY 1)")
def l11(spark, sf_dir):
    means = neighbours(spark, sf_dir).groupBy("query_id").agg(F.avg("score").alias("_m"))
    return means.agg(ROUND(F.corr("_m", "query_id")).alias("r"), F.count(F.lit(1)).alias("n"))


@register("l15_resumed_work", "SELECT q.event_id, q.user_id FROM events q WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_id = q.event_id AND d.user_id = q.user_id AND d.event_type = 'purchase')")
def l15(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    done = rows.filter("event_type = 'purchase'").select("event_id", "user_id")
    return rows.select("event_id", "user_id").join(done, ["event_id", "user_id"], "left_anti")


@register("l17_mean_pooled", "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings), m AS (SELECT label, place, avg(v) AS x FROM e GROUP BY 1, 2) SELECT label, place::INT AS place, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) AS value FROM m")
def l17(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return O.pooled(rows, "label", "v", F.lit(1.0)).select("label", "place", ROUND("value", 5).alias("value"))

"""Leakage-free splits, shuffles, set operations and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as S
from .catalog import register, table

KEYS = "(SELECT DISTINCT p_name AS key FROM part)"
HISTORY = "(SELECT DISTINCT p_name AS key, CASE WHEN md5(p_name) < '8' THEN 'train' WHEN md5(p_name) < '9' THEN 'test' ELSE 'valid' END AS split FROM part WHERE md5('h' || p_name) < '4')"


def keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("key")).distinct()


def history(spark, sf_dir, last: str = "valid"):
    h = F.md5("p_name")
    rows = table(spark, sf_dir, "part").filter(F.md5(F.concat(F.lit("h"), F.col("p_name"))) < "4")
    return rows.select(F.col("p_name").alias("key"), F.when(h < "8", "train").when(h < "9", "test").otherwise(last).alias("split")).distinct()


RANKED = f"(SELECT key, row_number() OVER (ORDER BY md5('42:' || key), key) - 1 AS r FROM {KEYS} WHERE key NOT IN (SELECT key FROM {HISTORY}))"


@register("i1_assign_new_keys", f"""WITH t AS (SELECT count(*) AS total FROM {KEYS}),
  k AS (SELECT count(*) FILTER (split = 'train') AS tr, count(*) FILTER (split = 'test') AS te, count(*) FILTER (split = 'valid') AS va FROM {HISTORY}),
  f AS (SELECT greatest(round_even(total * 0.8, 0) - tr, 0) AS d1, greatest(round_even(total * 0.1, 0) - te, 0) AS d2, greatest(round_even(total * 0.1, 0) - va, 0) AS d3, (SELECT count(*) FROM {RANKED}) AS n FROM t, k)
  SELECT key, CASE WHEN d1 + d2 + d3 = 0 THEN 'train' WHEN r < round_even(n * d1 / (d1 + d2 + d3), 0) THEN 'train' WHEN r < round_even(n * d1 / (d1 + d2 + d3), 0) + round_even(n * d2 / (d1 + d2 + d3), 0) THEN 'test' ELSE 'valid' END AS split FROM {RANKED}, f""")
def i1(spark, sf_dir):
    return S.assign_new(keys(spark, sf_dir), history(spark, sf_dir), "key")


@register("i2_assign_hashes", f"""WITH h AS (SELECT key, CASE split WHEN 'valid' THEN 'val' ELSE split END AS split FROM {HISTORY}),
  f AS (SELECT (SELECT count(*) FROM {KEYS}) AS n, count(*) FILTER (split = 'train') AS tr, count(*) FILTER (split = 'val') AS va FROM h)
  SELECT key, split FROM h UNION ALL
  SELECT key, CASE WHEN r < greatest(round(n * 0.8) - tr, 0) THEN 'train' WHEN r < greatest(round(n * 0.8) - tr, 0) + greatest(round(n * 0.1) - va, 0) THEN 'val' ELSE 'test' END FROM {RANKED}, f""")
def i2(spark, sf_dir):
    return S.assign_hashes(keys(spark, sf_dir), history(spark, sf_dir, "val"), "key")


@register("e1_keep_known", f"SELECT k.key, h.split FROM {KEYS} k LEFT JOIN {HISTORY} h ON k.key = h.key")
def e1(spark, sf_dir):
    return S.keep_known(keys(spark, sf_dir), history(spark, sf_dir), "key")


@register("e2_merge_history", f"SELECT key, split FROM {HISTORY} h WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_name = h.key AND p_partkey % 2 = 0) UNION ALL SELECT DISTINCT p_name, 'test' FROM part WHERE p_partkey % 2 = 0")
def e2(spark, sf_dir):
    batch = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_name").alias("key"), F.lit("test").alias("split")).distinct()
    return S.merge_history(batch, history(spark, sf_dir), "key")


@register("e3_conflicts", "SELECT DISTINCT a.l_partkey FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R'")
def e3(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    keyed = lambda f: rows.filter(F.col("l_returnflag") == f).select("l_partkey").distinct()
    return keyed("A").join(keyed("R"), "l_partkey")


@register("e4_all_files_wrong", """SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS wrong, count(*) AS files, count(*) FILTER (o_orderstatus = 'F') = count(*) AS all_wrong FROM orders GROUP BY 1
  HAVING count(*) FILTER (o_orderstatus = 'F') > 0""")
def e4(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    wrong = orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("wrong"))
    files = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("files"))
    return wrong.join(files, "o_custkey", "left").withColumn("all_wrong", F.col("wrong") == F.col("files"))


@register("e5_anchor_union", """SELECT c_custkey AS id, FALSE AS anchor FROM customer WHERE c_nationkey IS NULL OR c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey IS NOT NULL)
  UNION ALL SELECT s_suppkey, s_nationkey IN (SELECT c_nationkey FROM customer) FROM supplier""")
def e5(spark, sf_dir):
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    rest = customer.join(supplier.select(F.col("s_nationkey").alias("c_nationkey")), "c_nationkey", "left_anti").select(F.col("c_custkey").alias("id"), F.lit(False).alias("anchor"))
    known = customer.select(F.col("c_nationkey").alias("s_nationkey")).distinct().withColumn("_k", F.lit(True))
    anchors = supplier.join(known, "s_nationkey", "left").select(F.col("s_suppkey").alias("id"), F.coalesce("_k", F.lit(False)).alias("anchor"))
    return rest.unionByName(anchors)


@register("e6_first_prediction", "SELECT o_orderkey, coalesce(x.flag, '') AS flag FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS flag FROM lineitem WHERE l_discount > 0.03 GROUP BY 1) x ON o_orderkey = x.l_orderkey")
def e6(spark, sf_dir):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    first = table(spark, sf_dir, "lineitem").filter("l_discount > 0.03").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min_by("l_returnflag", order).alias("flag"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(first, "o_orderkey", "left").withColumn("flag", F.coalesce("flag", F.lit("")))


@register("e8_set_difference", "SELECT 'only_customer' AS side, count(*) AS n FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'both', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def e8(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").select("c_nationkey"), table(spark, sf_dir, "supplier").select("s_nationkey")
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return count(a.subtract(b), "only_customer").unionByName(count(a.intersect(b), "both"))


@register("e9_run_lookup", "SELECT r_name AS region, count(*) AS n FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def e9(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@register("b2_route_rows", f"SELECT s.split, count(*) AS n FROM part p JOIN (SELECT key, CASE WHEN md5(key) < '8' THEN 'train' WHEN md5(key) < '9' THEN 'test' ELSE 'valid' END AS split FROM {KEYS}) s ON p.p_name = s.key GROUP BY 1")
def b2(spark, sf_dir):
    h = F.md5("key")
    registry = keys(spark, sf_dir).select("key", F.when(h < "8", "train").when(h < "9", "test").otherwise("valid").alias("split"))
    return S.route(table(spark, sf_dir, "part").select(F.col("p_name").alias("key")), registry, "key").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("b4_shuffle_chunks", "SELECT event_id, (r // 100)::BIGINT AS chunk, (r % 100)::BIGINT AS place FROM (SELECT event_id, row_number() OVER (ORDER BY md5('42:' || event_id::VARCHAR), event_id) - 1 AS r FROM events)")
def b4(spark, sf_dir):
    return S.chunks(table(spark, sf_dir, "events").select("event_id"), "event_id", 100)


@register("b6_chunk_size", "SELECT floor(16 * 1073741824.0 * 0.8 / 4 * 0.6 / 250)::BIGINT AS first_pass, floor(16 * 1073741824.0 * 0.8 / 4 * 0.6 / 500)::BIGINT AS second_pass")
def b6(spark, sf_dir):
    return spark.range(1).select(F.lit(S.chunk_size(16, 4, 250)).cast("long").alias("first_pass"), F.lit(S.chunk_size(16, 4, 250, second_pass=True)).cast("long").alias("second_pass"))


@register("b7_conservation", "SELECT o_orderstatus AS split, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 9) AS share FROM orders GROUP BY 1")
def b7(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    total = orders.agg(F.count(F.lit(1)).alias("_t"))
    return orders.groupBy(F.col("o_orderstatus").alias("split")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("split", "n", F.round(F.col("n") / F.col("_t"), 9).alias("share"))


@register("b8_file_seed", "SELECT p_name, ('0x' || substr(sha256(p_name), 1, 8))::BIGINT + 42 AS seed FROM part GROUP BY 1")
def b8(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", S.file_seed(F.col("p_name")).alias("seed"))


@register("i3_unseen_keys", "SELECT count(*) AS unseen FROM (SELECT DISTINCT l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def i3(spark, sf_dir):
    known = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_partkey").distinct().join(known, "l_partkey", "left_anti").agg(F.count(F.lit(1)).alias("unseen"))


@register("i5_group_split", "SELECT key, CASE WHEN r < round(n * 0.8) THEN 'train' WHEN r < round(n * 0.8) + round(n * 0.1) THEN 'valid' ELSE 'test' END AS split FROM (SELECT key, row_number() OVER (ORDER BY md5('42:' || key), key) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT p_name AS key FROM part))")
def i5(spark, sf_dir):
    return S.group_split(keys(spark, sf_dir), "key")


@register("i9_duplicates", "SELECT p_name, count(*) AS copies, count(DISTINCT p_brand) AS folders FROM part GROUP BY 1 HAVING count(*) > 1")
def i9(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("p_brand").alias("folders")).filter("copies > 1")


@register("i10_incomplete_shards", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max(l_linenumber) <> count(DISTINCT l_linenumber)")
def i10(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("_m"), F.countDistinct("l_linenumber").alias("_c")).filter("_m <> _c").select("l_orderkey")


@register("i11_mapping_gaps", "SELECT 'missing' AS kind, count(*) AS n FROM (SELECT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size < 30) UNION ALL SELECT 'extra', count(*) FROM (SELECT p_partkey FROM part WHERE p_size < 30 EXCEPT SELECT l_partkey FROM lineitem)")
def i11(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"))
    mapped = table(spark, sf_dir, "part").filter("p_size < 30").select(F.col("p_partkey").alias("k"))
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count(seen.subtract(mapped), "missing").unionByName(count(mapped.subtract(seen), "extra"))

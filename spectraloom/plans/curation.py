"""Discovery, routing, predicates, schema, joins, counts and strings of corpus curation over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import clean, splits
from ..operators.windows import top_per_group
from ..sources import files
from .catalog import register, table
from .strings import BARE, SEQ, sequences

ROUND = lambda c, n=6: F.round(c, n)
#: A modified residue with what is attached to it.
SITE = r"[A-Z](?:\[[^\]]*\])*"


@register("a1_shards", "SELECT 'region' AS experiment, count(*) AS n FROM region")
def a1(spark, sf_dir):
    return files.scan_shards(spark, f"{sf_dir}/region.parquet").groupBy("experiment").agg(F.count(F.lit(1)).alias("n"))


@register("a2_spectrum_shards", "SELECT p_partkey, p_partkey % 5 <> 0 AS spectra FROM part")
def a2(spark, sf_dir):
    path = F.concat(F.lit("/data/run"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 5 == 0, "_lsh_assignments.parquet").otherwise(".parquet"))
    return table(spark, sf_dir, "part").select("p_partkey", (~path.rlike(r"lsh_assignments[^/]*\.parquet$")).alias("spectra"))


@register("a6_enriched", "SELECT o_orderkey, 'run' || (o_orderkey % 40)::VARCHAR AS experiment_name, CASE o_orderstatus WHEN 'F' THEN 'DDA' WHEN 'O' THEN 'DIA' END AS acquisition, 'mzspec:PXD1:run' || (o_orderkey % 40)::VARCHAR || ':scan:' || o_orderkey::VARCHAR AS usi FROM orders")
def a6(spark, sf_dir):
    path = F.concat(F.lit("/c/PXD1/run"), (F.col("o_orderkey") % 40).cast("string"), F.lit(".mzML_0001-0002.parquet"))
    rows = table(spark, sf_dir, "orders").withColumn("experiment_name", S.stem(path))
    return rows.select("o_orderkey", "experiment_name", F.when(F.col("o_orderstatus") == "F", "DDA").when(F.col("o_orderstatus") == "O", "DIA").alias("acquisition"), S.usi(S.accession(path), F.col("experiment_name"), F.col("o_orderkey").cast("string")).alias("usi"))


@register("a7_unambiguous_keys", "SELECT p_name AS key, any_value(p_brand) AS brand FROM part GROUP BY 1 HAVING count(*) = 1")
def a7(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.col("p_brand").alias("brand"))
    return part.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("brand").alias("brand")).filter("_n = 1").drop("_n")


@register("a8_last_row_wins", "SELECT 'p' || (o_custkey % 50)::VARCHAR AS key, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def a8(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string")).alias("key")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"))


@register("a9_seeded_sample", "SELECT event_id FROM events ORDER BY md5('7:' || event_id::VARCHAR), event_id LIMIT 100")
def a9(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id").orderBy(splits.order_hash(F.col("event_id"), 7), "event_id").limit(100)


@register("a12_paired_trees", "SELECT a.k AS run, a.n AS left_rows, b.n AS right_rows FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def a12(spark, sf_dir):
    count = lambda t, c, n: table(spark, sf_dir, t).groupBy(F.col(c).alias("run")).agg(F.count(F.lit(1)).alias(n))
    return count("customer", "c_nationkey", "left_rows").join(count("supplier", "s_nationkey", "right_rows"), "run")


@register("a13_mgf_records", "SELECT event_id, 'BEGIN IONS\nTITLE=pid=' || event_id::VARCHAR || '\nPEPMASS=' || printf('%.6f', value) || '\nCHARGE=2+\n' || printf('%.4f', value) || ' 1.0000\nEND IONS\n' AS record FROM events WHERE value IS NOT NULL")
def a13(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("value IS NOT NULL")
    record = files.peak_list_text(F.concat(F.lit("pid="), F.col("event_id").cast("string")), F.lit(2), F.col("value"), F.array("value"), F.array(F.lit(1.0)))
    return rows.select("event_id", record.alias("record"))


@register("a15_shard_names", "SELECT p_partkey, 'lcfm-' || split || '-' || lpad((row_number() OVER (PARTITION BY split ORDER BY p_partkey) - 1)::VARCHAR, 5, '0') || '-of-' || lpad((count(*) OVER (PARTITION BY split))::VARCHAR, 5, '0') || '.parquet' AS name FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE 'valid' END AS split FROM part)")
def a15(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "train").when(F.col("p_size") % 3 == 1, "test").otherwise("valid").alias("split"))
    number = F.row_number().over(Window.partitionBy("split").orderBy("p_partkey")) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy("split"))
    pad = lambda c: F.lpad(c.cast("string"), 5, "0")
    return rows.select("p_partkey", F.concat(F.lit("lcfm-"), "split", F.lit("-"), pad(number), F.lit("-of-"), pad(total), F.lit(".parquet")).alias("name"))


@register("a16_registry_labels", "SELECT p_name AS peptide, CASE WHEN md5(p_name) < '9' THEN 'train' ELSE 'valid' END AS split FROM part GROUP BY 1")
def a16(spark, sf_dir):
    stored = table(spark, sf_dir, "part").select(F.col("p_name").alias("peptide")).distinct().withColumn("split", F.when(F.md5("peptide") < "9", "train").otherwise("validation"))
    return stored.withColumn("split", F.when(F.col("split") == "validation", "valid").otherwise(F.col("split")))


@register("a17_remaining_work", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def a17(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@register("a18_published", "SELECT a.p_partkey AS path, CASE WHEN b.p_partkey IS NULL THEN 'missing' ELSE 'size_mismatch' END AS problem FROM part a LEFT JOIN (SELECT p_partkey, p_size + (p_partkey % 9 = 0)::INT AS size FROM part WHERE p_partkey % 11 <> 0) b ON a.p_partkey = b.p_partkey WHERE b.p_partkey IS NULL OR b.size <> a.p_size")
def a18(spark, sf_dir):
    local = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), "p_size")
    remote = local.filter("path % 11 <> 0").select("path", (F.col("p_size") + (F.col("path") % 9 == 0).cast("int")).alias("size"))
    both = local.join(remote, "path", "left").filter("size IS NULL OR size <> p_size")
    return both.select("path", F.when(F.col("size").isNull(), "missing").otherwise("size_mismatch").alias("problem"))


@register("b1_rows_per_file", "SELECT split, (r // 250)::BIGINT AS file, count(*) AS n FROM (SELECT event_type AS split, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id::VARCHAR), event_id) - 1 AS r FROM events) GROUP BY 1, 2")
def b1(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy(splits.order_hash(F.col("event_id")), "event_id")
    rows = table(spark, sf_dir, "events").withColumn("_r", F.row_number().over(w) - 1)
    return rows.groupBy(F.col("event_type").alias("split"), F.floor(F.col("_r") / 250).alias("file")).agg(F.count(F.lit(1)).alias("n"))


@register("b3_piles", "SELECT pile, event_id, row_number() OVER (PARTITION BY pile ORDER BY md5('42:' || event_id::VARCHAR), event_id) AS place FROM (SELECT event_id, ('0x' || substr(md5('pile:' || event_id::VARCHAR), 1, 8))::BIGINT % 16 AS pile FROM events)")
def b3(spark, sf_dir):
    pile = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("pile:"), F.col("event_id").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(16))
    rows = table(spark, sf_dir, "events").select(pile.alias("pile"), "event_id")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("pile").orderBy(splits.order_hash(F.col("event_id")), "event_id")))


@register("b5_whole_shuffle", "SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey::VARCHAR), o_orderkey) - 1 AS place FROM orders")
def b5(spark, sf_dir):
    return splits.ranked(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").withColumnRenamed("_rank", "place")


VOCABULARY = tuple("ACDEFGHIKLMNPQR") + ("[UNIMOD:4]", "[UNIMOD:1]")


@register("c6_predictable", f"SELECT p_partkey FROM (SELECT p_partkey, charge, regexp_extract_all(seq, '\\[[^\\]]*\\]|[A-Z]') AS t FROM {SEQ}) WHERE charge BETWEEN 1 AND 3 AND len(list_filter(t, lambda x: NOT list_contains({list(VOCABULARY)}, x))) = 0")
def c6(spark, sf_dir):
    known = F.array(*[F.lit(v) for v in VOCABULARY])
    rows = sequences(spark, sf_dir).filter(F.col("charge").try_cast("int").between(1, 3))
    return rows.filter(F.forall(S.tokens(F.col("seq")), lambda t: F.array_contains(known, t))).select("p_partkey")


@register("c7_loaded_rows", f"SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS prediction_id, 'group' || (p_partkey % 3)::VARCHAR AS validation_group FROM {SEQ} WHERE charge > 0 AND charge <= 2 AND NOT regexp_matches(seq, '[BJOUXZ]')")
def c7(spark, sf_dir):
    rows = sequences(spark, sf_dir).filter((F.col("charge") > 0) & (F.col("charge") <= 2) & ~F.col("seq").rlike("[BJOUXZ]"))
    # places by counts of ranges of the key: no sort of the whole table
    width = 10_000
    cells = rows.withColumn("_c", F.floor(F.col("p_partkey") / width))
    first = cells.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).withColumn("_f", F.coalesce(F.sum("_n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("_f") + F.row_number().over(Window.partitionBy("_c").orderBy("p_partkey")) - 1
    return cells.join(F.broadcast(first.select("_c", "_f")), "_c").select("p_partkey", place.alias("prediction_id"), F.concat(F.lit("group"), (F.col("p_partkey") % 3).cast("string")).alias("validation_group"))


@register("c9_qualified_runs", "SELECT o_orderkey, lower(trim(q)) = 'itraq' AS itraq, lower(q) LIKE '%tmt%' AND (m LIKE '%tmt16%' OR m LIKE '%tmt18%') AS tmt_high, lower(q) LIKE '%tmt%' AS fallback FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' iTRAQ ' WHEN 1 THEN 'TMT' WHEN 2 THEN 'label free' ELSE 'tmt pro' END AS q, CASE o_orderkey % 3 WHEN 0 THEN 'tmt16plex' ELSE 'tmt10plex' END AS m FROM orders)")
def c9(spark, sf_dir):
    key = F.col("o_orderkey")
    quant = F.when(key % 4 == 0, " iTRAQ ").when(key % 4 == 1, "TMT").when(key % 4 == 2, "label free").otherwise("tmt pro")
    mods = F.when(key % 3 == 0, "tmt16plex").otherwise("tmt10plex")
    tmt = F.lower(quant).contains("tmt")
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.lower(F.trim(quant)) == "itraq").alias("itraq"), (tmt & (F.lower(mods).contains("tmt16") | F.lower(mods).contains("tmt18"))).alias("tmt_high"), tmt.alias("fallback"))


@register("c10_unmodified", f"SELECT p_partkey, regexp_matches(seq, '^[A-Z]+$') AS unmodified, contains(replace(seq, 'K[', '#['), 'K') AS bare_lysine FROM {SEQ}")
def c10(spark, sf_dir):
    return sequences(spark, sf_dir).select("p_partkey", S.is_unmodified(F.col("seq")).alias("unmodified"), S.has_bare(F.col("seq"), "K").alias("bare_lysine"))


@register("c13_margin_selection", """WITH m AS (SELECT o_orderkey, o_totalprice AS margin FROM orders WHERE o_totalprice IS NOT NULL AND NOT isnan(o_totalprice)), q AS (SELECT quantile_cont(margin, [0.25, 0.5, 0.75]) AS e FROM m),
  t AS (SELECT o_orderkey, row_number() OVER (ORDER BY margin DESC, o_orderkey) <= 40 AS top FROM m),
  s AS (SELECT o_orderkey, row_number() OVER (PARTITION BY (margin > e[1])::INT + (margin > e[2])::INT + (margin > e[3])::INT ORDER BY md5('42:' || o_orderkey::VARCHAR), o_orderkey) <= 15 AS strat FROM m, q)
  SELECT t.o_orderkey, CASE WHEN top AND strat THEN 'top_margin+stratified' WHEN top THEN 'top_margin' ELSE 'stratified' END AS selection FROM t JOIN s USING (o_orderkey) WHERE top OR strat""")
def c13(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("margin")).filter("margin IS NOT NULL AND NOT isnan(margin)")
    top = rows.orderBy(F.desc("margin"), "o_orderkey").limit(40).select("o_orderkey", F.lit(True).alias("top"))
    edges = rows.agg(F.percentile("margin", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_e"))
    bins = rows.crossJoin(F.broadcast(edges)).withColumn("_b", sum((F.col("margin") > F.col("_e")[i]).cast("int") for i in range(3)))
    strat = top_per_group(bins, ["_b"], [splits.order_hash(F.col("o_orderkey")), F.col("o_orderkey")], 15).select("o_orderkey", F.lit(True).alias("strat"))
    both = top.join(strat, "o_orderkey", "full")
    return both.select("o_orderkey", F.when(F.col("top") & F.col("strat"), "top_margin+stratified").when(F.col("top"), "top_margin").otherwise("stratified").alias("selection"))


@register("d2_renamed", "SELECT c_custkey AS id, c_name, c_mktsegment FROM customer")
def d2(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return clean.rename(rows, {"c_custkey": "id", "missing": "x", "c_mktsegment": "c_name"})


@register("d7_found_column", "SELECT s_suppkey, s_name AS name FROM supplier")
def d7(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    return rows.select("s_suppkey", F.col(clean.find_column(rows.columns, ["title", "S_NAME", "s_suppkey"])).alias("name"))


@register("d8_overlap_ids", "SELECT event_id, coalesce(nullif(event_type, 'view'), 'mzspec:P:f' || (event_id % 9)::VARCHAR || ':scan:' || event_id::VARCHAR) AS usi, 'f' || (event_id % 9)::VARCHAR || ':' || event_id::VARCHAR AS overlap_id FROM events")
def d8(spark, sf_dir):
    key, name = F.col("event_id").cast("string"), F.concat(F.lit("f"), (F.col("event_id") % 9).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.nullif("event_type", F.lit("view")), S.usi(F.lit("P"), name, key)).alias("usi"), F.concat_ws(":", name, key).alias("overlap_id"))


@register("e7_by_position", "SELECT n.n_name, r.r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) n LEFT JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region) r ON n.i = r.i")
def e7(spark, sf_dir):
    # row positions of one file, by its key
    at = lambda t, k, c: table(spark, sf_dir, t).select(c, (F.row_number().over(Window.orderBy(k)) - 1).alias("_i"))
    return at("nation", "n_nationkey", "n_name").join(at("region", "r_regionkey", "r_name"), "_i", "left").drop("_i")


@register("e10_peptide_to_split", "SELECT DISTINCT p_name AS peptide, p_brand AS split FROM part")
def e10(spark, sf_dir):
    sets = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("split")).agg(F.collect_set("p_name").alias("_s"))
    return sets.select(F.explode("_s").alias("peptide"), "split")


@register("e11_backbone_pairs", """WITH g AS (SELECT l_suppkey, l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), t AS (SELECT l_suppkey, sum(n) AS total FROM g GROUP BY 1), b AS (SELECT l_suppkey, l_partkey, sum(n) AS own FROM g GROUP BY 1, 2)
  SELECT x.l_suppkey, x.l_partkey, y.l_returnflag AS modified, x.n AS base, y.n AS mods, greatest(total - own, 0)::BIGINT AS negatives FROM g x JOIN g y ON x.l_suppkey = y.l_suppkey AND x.l_partkey = y.l_partkey AND y.l_returnflag <> 'N' JOIN t ON t.l_suppkey = x.l_suppkey JOIN b ON b.l_suppkey = x.l_suppkey AND b.l_partkey = x.l_partkey WHERE x.l_returnflag = 'N'""")
def e11(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    total = g.groupBy("l_suppkey").agg(F.sum("n").alias("_t"))
    own = g.groupBy("l_suppkey", "l_partkey").agg(F.sum("n").alias("_o"))
    base = g.filter("l_returnflag = 'N'").select("l_suppkey", "l_partkey", F.col("n").alias("base"))
    mods = g.filter("l_returnflag <> 'N'").select("l_suppkey", "l_partkey", F.col("l_returnflag").alias("modified"), F.col("n").alias("mods"))
    out = base.join(mods, ["l_suppkey", "l_partkey"]).join(own, ["l_suppkey", "l_partkey"]).join(total, "l_suppkey")
    return out.select("l_suppkey", "l_partkey", "modified", "base", "mods", F.greatest(F.col("_t") - F.col("_o"), F.lit(0).cast("long")).alias("negatives"))


@register("f5_split_rows_and_files", "SELECT o_orderstatus AS split, count(*) AS n, count(DISTINCT o_custkey % 40) AS files FROM orders GROUP BY 1")
def f5(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("split")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.col("o_custkey") % 40).alias("files"))


@register("f11_label_evidence", f"SELECT file, site, min(p_partkey) AS evidence FROM (SELECT p_partkey, p_partkey % 10 AS file, unnest(regexp_extract_all(seq, '[A-Z]\\[[^\\]]*\\]')) AS site FROM {SEQ}) GROUP BY 1, 2")
def f11(spark, sf_dir):
    rows = sequences(spark, sf_dir).select((F.col("p_partkey") % 10).alias("file"), "p_partkey", F.explode(F.regexp_extract_all("seq", F.lit(r"([A-Z]\[[^\]]*\])"), F.lit(1))).alias("site"))
    return rows.groupBy("file", "site").agg(F.min("p_partkey").alias("evidence"))


@register("f12_modification_counts", f"SELECT site[1] AS residue, site[2:] AS encoding, project, count(*) AS n FROM (SELECT p_partkey % 4 AS project, unnest(regexp_extract_all(seq, '[A-Z]\\[[^\\]]*\\]')) AS site FROM {SEQ}) GROUP BY 1, 2, 3")
def f12(spark, sf_dir):
    rows = sequences(spark, sf_dir).select((F.col("p_partkey") % 4).alias("project"), F.explode(F.regexp_extract_all("seq", F.lit(r"([A-Z]\[[^\]]*\])"), F.lit(1))).alias("_s"))
    return rows.groupBy(F.substring("_s", 1, 1).alias("residue"), F.expr("substring(_s, 2)").alias("encoding"), "project").agg(F.count(F.lit(1)).alias("n"))


@register("f13_quant_summary", "SELECT o_orderpriority AS tag, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS dia, count(DISTINCT CASE WHEN o_orderstatus <> 'F' THEN o_custkey END) AS other FROM orders GROUP BY 1")
def f13(spark, sf_dir):
    dia = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("tag")).agg(F.countDistinct(F.when(dia, F.col("o_custkey"))).alias("dia"), F.countDistinct(F.when(~dia, F.col("o_custkey"))).alias("other"))


@register("f15_lysine_rollup", f"SELECT p_partkey % 6 AS project, count(*) AS files, sum(n)::BIGINT AS rows_seen, round(100.0 * sum(bare) / sum(n), 6) AS percent FROM (SELECT p_partkey % 60 AS p_partkey, count(*) AS n, count_if(contains(seq, 'K')) AS bare FROM {SEQ} GROUP BY 1) GROUP BY 1")
def f15(spark, sf_dir):
    by_file = sequences(spark, sf_dir).groupBy((F.col("p_partkey") % 60).alias("_f")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(S.has_bare(F.col("seq"), "K")).alias("_b"))
    return by_file.groupBy((F.col("_f") % 6).alias("project")).agg(F.count(F.lit(1)).alias("files"), F.sum("_n").alias("rows_seen"), ROUND(100.0 * F.sum("_b") / F.sum("_n")).alias("percent"))


@register("f16_intensity_classes", "SELECT CASE WHEN l_tax IS NULL THEN 'missing_sf_column' WHEN abs(l_discount - 0.05) > 0.03 THEN 'bad_max' WHEN l_tax <= 0 THEN 'bad_scale' ELSE 'ok' END AS class, count(*) AS n FROM lineitem GROUP BY 1")
def f16(spark, sf_dir):
    kind = clean.first_failing([("missing_sf_column", F.col("l_tax").isNull()), ("bad_max", F.abs(F.col("l_discount") - 0.05) > 0.03), ("bad_scale", F.col("l_tax") <= 0)], "ok")
    return table(spark, sf_dir, "lineitem").groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@register("f54_attrition", "SELECT step, n FROM (SELECT count(*) AS n0, count_if(l_quantity <= 40) AS n1, count_if(l_quantity <= 40 AND l_discount <= 0.08) AS n2, count_if(l_quantity <= 40 AND l_discount <= 0.08 AND l_tax > 0) AS n3 FROM lineitem) UNPIVOT (n FOR step IN (n0, n1, n2, n3))")
def f54(spark, sf_dir):
    checks = [F.col("l_quantity") <= 40, F.col("l_discount") <= 0.08, F.col("l_tax") > 0]
    so_far, counts = F.lit(True), [F.count(F.lit(1)).alias("n0")]
    for i, c in enumerate(checks):
        so_far = so_far & c
        counts.append(F.count_if(so_far).alias(f"n{i + 1}"))
    return table(spark, sf_dir, "lineitem").agg(*counts).unpivot([], [f"n{i}" for i in range(4)], "step", "n")


@register("j2_ensured_peptide", f"SELECT p_partkey, coalesce(CASE WHEN p_partkey % 4 = 0 THEN 'GIVEN' END, {BARE}) AS peptide FROM {SEQ}")
def j2(spark, sf_dir):
    rows = sequences(spark, sf_dir).withColumn("given", F.when(F.col("p_partkey") % 4 == 0, "GIVEN"))
    return rows.select("p_partkey", F.coalesce("given", S.strip_modifications(F.col("seq"))).alias("peptide"))


CODES = (("[UNIMOD:4]", "[+57.0215]"), ("[UNIMOD:35]", "[+15.9949]"), ("[UNIMOD:1]", "[+42.0106]"))


@register("j4_mass_shifts", f"SELECT p_partkey, replace(replace(replace(seq, '[UNIMOD:4]', '[+57.0215]'), '[UNIMOD:35]', '[+15.9949]'), '[UNIMOD:1]', '[+42.0106]') AS shifted FROM {SEQ}")
def j4(spark, sf_dir):
    return sequences(spark, sf_dir).select("p_partkey", S.replace_all(F.col("seq"), CODES).alias("shifted"))


@register("j5_terminal_notation", f"SELECT p_partkey, regexp_replace(replace(seq, '[UNIMOD:35]', '(Oxidation)'), '^\\[UNIMOD:1\\]-', '.(Acetyl)') AS notation FROM {SEQ}")
def j5(spark, sf_dir):
    return sequences(spark, sf_dir).select("p_partkey", F.regexp_replace(F.replace("seq", F.lit("[UNIMOD:35]"), F.lit("(Oxidation)")), r"^\[UNIMOD:1\]-", ".(Acetyl)").alias("notation"))


@register("j6_replaced", f"SELECT p_partkey, replace(replace(replace(seq, '[UNIMOD:1]-', 'n[43]'), 'C[UNIMOD:4]', 'C[160]'), 'M[UNIMOD:35]', 'M[147]') AS relabelled FROM {SEQ}")
def j6(spark, sf_dir):
    return sequences(spark, sf_dir).select("p_partkey", S.replace_all(F.col("seq"), (("[UNIMOD:1]-", "n[43]"), ("C[UNIMOD:4]", "C[160]"), ("M[UNIMOD:35]", "M[147]"))).alias("relabelled"))


@register("j7_mapping_rows", "SELECT site, regexp_extract(site, '^[A-Zn]', 0) || '[UNIMOD:' || (sum(length(site)) % 99)::VARCHAR || ']' AS encoding, count(*) AS n FROM (SELECT CASE p_size % 3 WHEN 0 THEN 'K[242]' WHEN 1 THEN 'n[43]' ELSE 'C[160]' END AS site FROM part) GROUP BY 1")
def j7(spark, sf_dir):
    site = F.when(F.col("p_size") % 3 == 0, "K[242]").when(F.col("p_size") % 3 == 1, "n[43]").otherwise("C[160]")
    rows = table(spark, sf_dir, "part").groupBy(site.alias("site")).agg(F.sum(F.length(site)).alias("_s"), F.count(F.lit(1)).alias("n"))
    return rows.select("site", F.concat(F.regexp_extract("site", "^[A-Zn]", 0), F.lit("[UNIMOD:"), (F.col("_s") % 99).cast("string"), F.lit("]")).alias("encoding"), "n")


@register("j8_file_overrides", "SELECT p_partkey, coalesce(CASE WHEN contains(p_name, p) THEN p END, 'plain') AS rule FROM part LEFT JOIN (SELECT left(r_name, 2) AS p FROM region WHERE r_regionkey = 0) ON contains(p_name, p)")
def j8(spark, sf_dir):
    patterns = table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.substring("r_name", 1, 2).alias("_p"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return part.join(F.broadcast(patterns), F.contains("p_name", "_p"), "left").select("p_partkey", F.coalesce("_p", F.lit("plain")).alias("rule"))


@register("j12_shard_owner", "WITH s AS (SELECT p_partkey // 100 AS shard, min(p_partkey) AS low FROM part GROUP BY 1) SELECT p_partkey, (SELECT max(shard) FROM s WHERE low <= p_partkey) AS owner FROM part")
def j12(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    shards = part.groupBy(F.floor(F.col("p_partkey") / 100).alias("shard")).agg(F.min("p_partkey").alias("low"))
    marks = part.select("p_partkey", F.lit(None).cast("long").alias("shard")).unionByName(shards.select(F.col("low").alias("p_partkey"), "shard"))
    # the last shard whose least row is at or before: by cells of keys, and the cells before them
    cell = F.floor(F.col("p_partkey") / 10_000)
    last = marks.withColumn("_c", cell).groupBy("_c").agg(F.max("shard").alias("_m"))
    before = last.select("_c", F.max("_m").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)).alias("_b"))
    w = Window.partitionBy("_c").orderBy("p_partkey", F.col("shard").asc_nulls_last())
    run = marks.withColumn("_c", cell).join(F.broadcast(before), "_c").withColumn("owner", F.coalesce(F.max("shard").over(w), "_b"))
    return run.filter("shard IS NULL").select("p_partkey", "owner")


@register("j16_backbones", f"SELECT p_partkey, len(t)::INT AS n_tokens, array_to_string(list_transform(t, lambda x: replace(x[1], 'I', 'L')), '') AS backbone FROM (SELECT p_partkey, regexp_extract_all(replace(seq, '[UNIMOD:1]-', ''), '[A-Z](?:\\[[^\\]]*\\])*') AS t FROM {SEQ})")
def j16(spark, sf_dir):
    found = F.regexp_extract_all(F.regexp_replace("seq", r"^\[[^\]]*\]-", ""), F.lit(f"({SITE})"), F.lit(1))
    return sequences(spark, sf_dir).select("p_partkey", F.size(found).alias("n_tokens"), F.array_join(F.transform(found, lambda t: F.translate(F.substring(t, 1, 1), "I", "L")), "").alias("backbone"))


NEXT = f"(SELECT a.p_partkey, a.seq AS x, b.seq AS y FROM {SEQ} a JOIN {SEQ} b ON b.p_partkey = a.p_partkey + 1)"


def following(spark, sf_dir):
    rows = sequences(spark, sf_dir).select("p_partkey", F.col("seq").alias("x"))
    return rows.join(rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y")), "p_partkey")


def bare_sql(c):
    return BARE.replace("seq", c)


@register("j18_similarity", f"SELECT p_partkey, round(1 - levenshtein({bare_sql('x')}, {bare_sql('y')}) / greatest(length({bare_sql('x')}), length({bare_sql('y')})), 6) AS similarity FROM {NEXT}")
def j18(spark, sf_dir):
    t = lambda c: S.tokens(S.strip_modifications(F.col(c)))
    return following(spark, sf_dir).select("p_partkey", ROUND(S.similarity(t("x"), t("y"))).alias("similarity"))


@register("j19_clean_site_distance", f"""WITH t AS (SELECT p_partkey, regexp_extract_all(replace(x, '[UNIMOD:1]-', ''), '[A-Z](?:\\[[^\\]]*\\])*') AS a, regexp_extract_all(replace(y, '[UNIMOD:1]-', ''), '[A-Z](?:\\[[^\\]]*\\])*') AS b FROM {NEXT}),
  z AS (SELECT p_partkey, len(a) AS la, len(b) AS lb, list_filter(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: CASE WHEN length(a[i]) = 1 AND length(b[i]) = 1 THEN a[i] || b[i] END), lambda p: p IS NOT NULL) AS p FROM t)
  SELECT p_partkey, (levenshtein(array_to_string(list_transform(p, lambda q: q[1]), ''), array_to_string(list_transform(p, lambda q: q[2]), '')) + abs(la - lb))::INT AS distance FROM z""")
def j19(spark, sf_dir):
    found = lambda c: F.regexp_extract_all(F.regexp_replace(c, r"^\[[^\]]*\]-", ""), F.lit(f"({SITE})"), F.lit(1))
    rows = following(spark, sf_dir).select("p_partkey", found("x").alias("a"), found("y").alias("b"))
    n = F.least(F.size("a"), F.size("b"))
    both = F.filter(F.zip_with(F.slice("a", 1, n), F.slice("b", 1, n), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: (F.length(p["x"]) == 1) & (F.length(p["y"]) == 1))
    rows = rows.withColumn("_p", both)
    side = lambda c: F.transform("_p", lambda p: p[c])
    return rows.select("p_partkey", (S.token_distance(side("x"), side("y")) + F.abs(F.size("a") - F.size("b"))).alias("distance"))


@register("j21_modification_types", f"""SELECT p_partkey, coalesce(nullif(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(seq, 'UNIMOD:(\\d+)', 1), lambda i: CASE i WHEN '1' THEN 'Acetyl' WHEN '4' THEN 'Carbamidomethyl' WHEN '35' THEN 'Oxidation' ELSE 'Other' END))), ' + '), ''), 'Unmodified') AS types FROM {SEQ}""")
def j21(spark, sf_dir):
    return sequences(spark, sf_dir).select("p_partkey", S.modification_types(F.col("seq")).alias("types"))


@register("j22_flags", "SELECT event_id, event_id % 4 = 0 AS phospho, event_id % 4 = 1 AS glyco, event_id % 4 = 2 AS deamidated FROM events")
def j22(spark, sf_dir):
    key = F.col("event_id")
    seq = F.when(key % 4 == 0, "AS[UNIMOD:21]K").when(key % 4 == 1, "AN(HexNAc)K").when(key % 4 == 2, "AN[UNIMOD:7]K").otherwise("AQ[UNIMOD:7]K")
    return table(spark, sf_dir, "events").select("event_id", S.has_phospho(seq).alias("phospho"), S.has_glyco_text(seq).alias("glyco"), S.has_deamidated_n(seq).alias("deamidated"))


@register("j28_prediction_ids", "SELECT event_id, 'pid=' || event_id::VARCHAR AS title, event_id::VARCHAR AS prediction_id, (event_id % 24)::INT AS fraction FROM events")
def j28(spark, sf_dir):
    title = F.concat(F.lit("pid="), F.col("event_id").cast("string"))
    stem = F.concat(F.lit("run_F"), (F.col("event_id") % 24).cast("string"), F.lit("_HCD"))
    return table(spark, sf_dir, "events").select("event_id", title.alias("title"), F.regexp_extract(title, r"pid=(\S+)", 1).alias("prediction_id"), F.regexp_extract(stem, r"_F(\d+)", 1).try_cast("int").alias("fraction"))


@register("j29_parsed_encodings", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'K' END AS residue, event_id % 2 = 0 AS terminal, (event_id % 300)::DOUBLE AS delta FROM events")
def j29(spark, sf_dir):
    number = (F.col("event_id") % 300).cast("string")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("n["), number, F.lit("]A"))).otherwise(F.concat(F.lit("K["), number, F.lit("]")))
    residue = F.coalesce(F.nullif(F.regexp_extract(text, r"^n\[[^\]]*\]([A-Z])$", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"^([A-Z])\[", 1), F.lit("")))
    return table(spark, sf_dir, "events").select("event_id", residue.alias("residue"), text.startswith("n[").alias("terminal"), F.regexp_extract(text, r"\[(-?[\d.]+)\]", 1).try_cast("double").alias("delta"))


@register("j30_nearest_delta", "SELECT l_partkey, l_linenumber, arg_min(p_size, (abs(p_size - l_quantity), p_size)) AS nearest FROM lineitem JOIN (SELECT DISTINCT p_partkey % 10 AS r, p_size FROM part) ON r = l_partkey % 10 GROUP BY 1, 2")
def j30(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", "l_quantity").distinct().withColumn("_r", F.col("l_partkey") % 10)
    known = table(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("_r"), "p_size").distinct()
    return seen.join(known, "_r").groupBy("l_partkey", "l_linenumber").agg(F.min_by("p_size", F.struct(F.abs(F.col("p_size") - F.col("l_quantity")), "p_size")).alias("nearest"))

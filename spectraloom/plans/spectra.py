"""Peak matching, similarity, quality and masks over lineitem as spectra."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import peaks as P
from ..functions.sequences import PROTON
from ..operators import fragments as G
from ..operators import spectra as O
from ..operators import windows as W
from .analytics import PEAKS, peaks, spectra
from .catalog import register, table
from .fragments import IONS, ions
from .strings import SEQ, sequences

ROUND = lambda c, n=6: F.round(c, n)
AS_PAIRS = "(SELECT o_orderkey AS a, o_orderkey + 1 AS b FROM orders WHERE o_orderkey + 1 IN (SELECT o_orderkey FROM orders))"


def pairs(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"))
    return a.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("b")), "b", "left_semi").select("a", "b")


@register("k6_binned_cosine", f"""WITH c AS (SELECT spectrum, floor(mz / 200) AS bin, sum(intensity) AS i FROM {PEAKS} GROUP BY 1, 2), n AS (SELECT spectrum, sqrt(sum(i * i)) AS n FROM c GROUP BY 1),
  d AS (SELECT p.a, p.b, sum(x.i * y.i) AS d FROM {AS_PAIRS} p JOIN c x ON x.spectrum = p.a JOIN c y ON y.spectrum = p.b AND y.bin = x.bin GROUP BY 1, 2),
  s AS (SELECT p.a, p.b, coalesce(d / (x.n * y.n), 0) AS cosine FROM {AS_PAIRS} p LEFT JOIN d ON d.a = p.a AND d.b = p.b LEFT JOIN n x ON x.spectrum = p.a LEFT JOIN n y ON y.spectrum = p.b)
  SELECT a, b, round(cosine, 6) AS cosine, round(1 - 2 * acos(least(greatest(cosine, 0), 1)) / pi(), 5) AS angle FROM s""")
def k6(spark, sf_dir):
    out = O.binned_cosine(peaks(spark, sf_dir), pairs(spark, sf_dir), "spectrum", "a", "b", "mz", "intensity", 200.0)
    return out.select("a", "b", ROUND("cosine").alias("cosine"), ROUND("angle", 5).alias("angle"))


@register("k7_intensity_quality", f"""SELECT spectrum, round(coalesce(sum(CASE WHEN line % 2 = 0 THEN intensity END) / sum(intensity), 0), 6) AS explained,
  round(coalesce(quantile_cont(CASE WHEN line % 2 = 0 THEN intensity END, 0.5), 0) / coalesce(quantile_cont(CASE WHEN line % 2 = 1 THEN intensity END, 0.5), 1e-6), 4) AS snr, round(max(intensity) / min(intensity), 6) AS dynamic_range FROM {PEAKS} GROUP BY 1""")
def k7(spark, sf_dir):
    out = O.intensity_quality(peaks(spark, sf_dir), "spectrum", "intensity", F.col("line") % 2 == 0)
    return out.select("spectrum", ROUND("explained").alias("explained"), ROUND("snr", 4).alias("snr"), ROUND("dynamic_range").alias("dynamic_range"))


@register("k8_uniformity", f"""WITH c AS (SELECT spectrum, CASE WHEN mz < 50 THEN 0 WHEN mz < 2500 THEN 1 ELSE least(floor((mz - 2500) / 500) + 2, 6) END AS b, count(*) AS n, min(mz) AS l, max(mz) AS h, bool_and(mz BETWEEN 0 AND 5000) AS inside FROM {PEAKS} GROUP BY 1, mz > 5000, 2),
  s AS (SELECT spectrum, sum(n) AS n, sum(n) FILTER (inside) AS t, sum(n * ln(n)) FILTER (inside) AS s, count(*) FILTER (inside) AS k, max(h) - min(l) AS span FROM c GROUP BY 1)
  SELECT spectrum, n::BIGINT AS n, round(CASE WHEN n < 2 OR k = 0 THEN 0 WHEN k = 1 THEN ln(t) - s / t ELSE (ln(t) - s / t) / ln(k) END, 6) AS uniformity, round(CASE WHEN span > 0 THEN n / span ELSE 0 END, 6) AS density FROM s""")
def k8(spark, sf_dir):
    out = O.uniformity(peaks(spark, sf_dir), "spectrum", "mz")
    return out.select("spectrum", "n", ROUND("uniformity").alias("uniformity"), ROUND("density").alias("density"))


MATCHED = "(SELECT DISTINCT l_orderkey AS spectrum, CASE WHEN l_returnflag = 'N' THEN 'b' ELSE 'y' END AS series, l_linenumber AS position, 8 AS length FROM lineitem)"


def matched(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("spectrum"), F.when(F.col("l_returnflag") == "N", "b").otherwise("y").alias("series"), F.col("l_linenumber").alias("position"), F.lit(8).alias("length")).distinct()


@register("k9_sequencing", f"""WITH m AS {MATCHED}, r AS (SELECT spectrum, series, position - row_number() OVER (PARTITION BY spectrum, series ORDER BY position) AS i FROM m),
  l AS (SELECT spectrum, max(n) AS longest FROM (SELECT spectrum, count(*) AS n FROM r GROUP BY spectrum, series, i) GROUP BY 1),
  c AS (SELECT spectrum, count(DISTINCT CASE series WHEN 'b' THEN position ELSE length - position + 1 END) AS c FROM m GROUP BY 1)
  SELECT m.spectrum, max(longest) AS longest, round(count(*) FILTER (series = 'b') / (count(*) FILTER (series = 'y') + 1e-6), 3) AS bias, round(max(c) / 8, 6) AS coverage FROM m JOIN l ON l.spectrum = m.spectrum JOIN c ON c.spectrum = m.spectrum GROUP BY 1""")
def k9(spark, sf_dir):
    out = O.sequencing(matched(spark, sf_dir), "spectrum", "series", "position", "length")
    return out.select("spectrum", "longest", ROUND("bias", 3).alias("bias"), ROUND("coverage").alias("coverage"))


@register("k10_backbone_coverage", f"SELECT spectrum, count(DISTINCT CASE series WHEN 'b' THEN position ELSE length - position END) AS sites, count(*) AS groups, round(count(DISTINCT CASE series WHEN 'b' THEN position ELSE length - position END) / 7, 6) AS coverage FROM {MATCHED} GROUP BY 1")
def k10(spark, sf_dir):
    out = O.cleavage_coverage(matched(spark, sf_dir), "spectrum", "series", "position", "length")
    return out.select("spectrum", "sites", "groups", ROUND("coverage").alias("coverage"))


@register("k2_peak_orders", f"""SELECT spectrum, array_to_string(list_transform(list(line ORDER BY mz, intensity, line), lambda x: x::VARCHAR), ',') AS by_mz, array_to_string(list_transform(list(line ORDER BY md5('42:' || spectrum::VARCHAR || ':' || line::VARCHAR), line, mz, intensity), lambda x: x::VARCHAR), ',') AS shuffled FROM {PEAKS} GROUP BY 1""")
def k2(spark, sf_dir):
    rows = peaks(spark, sf_dir).withColumn("_h", F.md5(F.concat(F.lit("42:"), F.col("spectrum").cast("string"), F.lit(":"), F.col("line").cast("string"))))
    lists = rows.groupBy("spectrum").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity", "line"))).alias("_m"), F.array_sort(F.collect_list(F.struct("_h", "line", "mz", "intensity"))).alias("_s"))
    text = lambda c: F.array_join(F.transform(c, lambda p: p["line"].cast("string")), ",")
    return lists.select("spectrum", text("_m").alias("by_mz"), text("_s").alias("shuffled"))


@register("k3_padded", f"SELECT spectrum, least(count(*), 4)::INT AS kept, round(coalesce(list_sum(list(mz ORDER BY mz, intensity, line)[:4]), 0), 6) AS total, 4 AS width FROM {PEAKS} GROUP BY 1")
def k3(spark, sf_dir):
    rows = spectra(spark, sf_dir).withColumn("_p", P.pad(F.col("mz"), 4))
    return rows.select("spectrum", F.least(F.size("mz"), F.lit(4)).alias("kept"), ROUND(P.total(F.col("_p"))).alias("total"), F.size("_p").alias("width"))


@register("k24_row_cosine", f"{'WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)'} SELECT a.vec_id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 6) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def k24(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return rows.join(other, "vec_id").select("vec_id", ROUND(P.cosine(F.col("v"), F.col("w"))).alias("cosine"))


@register("k15_encoded_metadata", """SELECT c_custkey, CASE lower(trim(c_mktsegment)) WHEN 'automobile' THEN 1 WHEN 'building' THEN 2 WHEN 'machinery' THEN 3 ELSE 0 END AS segment, CASE WHEN c_acctbal IS NULL THEN 0 WHEN c_acctbal < 0 THEN 1 WHEN c_acctbal < 5000 THEN 2 ELSE 3 END AS balance,
  round(least(greatest(c_acctbal / 10000, 0), 1), 6) AS scaled FROM customer""")
def k15(spark, sf_dir):
    vocabulary = F.create_map(*[F.lit(x) for x in ("automobile", 1, "building", 2, "machinery", 3)])
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.coalesce(F.try_element_at(vocabulary, F.lower(F.trim("c_mktsegment"))), F.lit(0)).alias("segment"),
        F.when(b.isNull(), 0).when(b < 0, 1).when(b < 5000, 2).otherwise(3).alias("balance"), ROUND(F.least(F.greatest(b / 10000, F.lit(0.0)), F.lit(1.0))).alias("scaled"),
    )


@register("k20_isotope_neighbours", f"""SELECT a.spectrum, a.line, count(*) AS neighbours FROM {PEAKS} a JOIN {PEAKS} b ON a.spectrum = b.spectrum AND a.intensity > 25 AND (a.mz, a.line, a.intensity) <> (b.mz, b.line, b.intensity)
  CROSS JOIN (VALUES (-40.0), (-20.0), (20.0), (40.0)) s(d) WHERE abs(b.mz - a.mz - d) <= 5 GROUP BY 1, 2""")
def k20(spark, sf_dir):
    rows = peaks(spark, sf_dir)
    shifted = rows.filter("intensity > 25").withColumn("_d", F.explode(F.array(*[F.lit(d) for d in (-40.0, -20.0, 20.0, 40.0)]))).withColumn("_x", F.col("mz") + F.col("_d"))
    other = rows.select("spectrum", F.col("mz").alias("mz_b"), F.col("line").alias("line_b"), F.col("intensity").alias("intensity_b"))
    found = W.band_join(shifted, other, ["spectrum"], "_x", "mz_b", 5.0).filter("NOT (mz = mz_b AND line = line_b AND intensity = intensity_b)")
    return found.groupBy("spectrum", "line").agg(F.count(F.lit(1)).alias("neighbours"))


@register("k22_confidence_weights", """SELECT o_custkey, count(*) AS n, round(avg(1 / (1 + exp(-(o_totalprice - p[2]) / greatest(p[3] - p[1], 1e-6)))), 6) AS weight FROM orders JOIN (SELECT o_custkey AS k, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS p FROM orders GROUP BY 1) ON k = o_custkey GROUP BY 1""")
def k22(spark, sf_dir):
    rows = O.normalised_confidence(table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice")
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), ROUND(F.avg(1 / (1 + F.exp(-F.col("normalised"))))).alias("weight"))


@register("k5_hyperplane_hashes")
def k5(spark, sf_dir):
    """Equal spectra have equal hashes; tested against NumPy."""
    return O.hyperplane_hashes(spectra(spark, sf_dir), "spectrum", "mz", "intensity", 2200.0, 20.0)


@register("e13_matched_peaks")
def e13(spark, sf_dir):
    """Consecutive spectra: most intense first, nearest free peak within 20. Tested by brute force."""
    rows = peaks(spark, sf_dir).withColumn("peak", F.concat_ws(":", "mz", "line", "intensity"))
    left = pairs(spark, sf_dir).join(rows.select(F.col("spectrum").alias("a"), "mz", "intensity", F.col("peak").alias("left")), "a")
    right = pairs(spark, sf_dir).join(rows.select(F.col("spectrum").alias("b"), F.col("mz").alias("mz_b"), F.col("peak").alias("right")), "b")
    near = W.band_join(left, right, ["a", "b"], "mz", "mz_b", 20.0).withColumn("distance", F.abs(F.col("mz") - F.col("mz_b")))
    return O.match_most_intense_first(near, ["a", "b"], "left", "right", "intensity", "distance").groupBy("a", "b").agg(F.count(F.lit(1)).alias("matched"))


@register("e15_parent_child", """SELECT c.l_orderkey, c.l_linenumber AS child, p.l_linenumber AS parent, count(*) AS pairs FROM lineitem c JOIN lineitem p ON p.l_orderkey = c.l_orderkey AND p.l_linenumber = c.l_linenumber - 1 AND p.l_returnflag = 'N' WHERE c.l_returnflag <> 'N' GROUP BY 1, 2, 3""")
def e15(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    child = rows.filter("l_returnflag <> 'N'").select("l_orderkey", F.col("l_linenumber").alias("child"), (F.col("l_linenumber") - 1).alias("parent"))
    parent = rows.filter("l_returnflag = 'N'").select("l_orderkey", F.col("l_linenumber").alias("parent"))
    return child.join(parent, ["l_orderkey", "parent"]).groupBy("l_orderkey", "child", "parent").agg(F.count(F.lit(1)).alias("pairs"))


@register("e18_charge_variants", f"""{IONS}, two AS (SELECT p_partkey, series, position, (mz - {PROTON}) / 2 + {PROTON} AS mz FROM ions WHERE position % 2 = 0)
  SELECT i.p_partkey, count(*) AS variants FROM ions i JOIN two t ON t.p_partkey = i.p_partkey AND abs((i.mz + {PROTON}) / 2 - t.mz) <= 0.01 GROUP BY 1""")
def e18(spark, sf_dir):
    one = ions(spark, sf_dir)
    seen = one.filter("position % 2 = 0").select("p_partkey", ((F.col("mz") - PROTON) / 2 + PROTON).alias("peak_mz"))
    return O.charge_variants(one, seen, ["p_partkey"], "mz", "charge", "peak_mz", 0.01, 2, PROTON).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("variants"))


@register("f34_mask_curves", f"""WITH r AS (SELECT spectrum, intensity > 25 AS m, ntile(3) OVER (PARTITION BY spectrum ORDER BY intensity, mz, line) AS tile FROM {PEAKS}) SELECT tile, count(*) AS n, round(avg(m::INT), 6) AS rate FROM r GROUP BY 1""")
def f34(spark, sf_dir):
    w = Window.partitionBy("spectrum").orderBy("intensity", "mz", "line")
    rows = peaks(spark, sf_dir).withColumn("tile", F.ntile(3).over(w))
    return rows.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), ROUND(F.avg((F.col("intensity") > 25).cast("int"))).alias("rate"))


@register("f33_gap_coverage", f"""WITH g AS (SELECT spectrum, mz - lag(mz) OVER (PARTITION BY spectrum ORDER BY mz, intensity, line) AS gap FROM {PEAKS}) SELECT w AS width, count(gap) AS n, round(avg((gap <= w)::INT), 6) AS inside FROM g, (VALUES (10), (50), (100), (250), (500)) s(w) WHERE gap IS NOT NULL GROUP BY 1""")
def f33(spark, sf_dir):
    w = Window.partitionBy("spectrum").orderBy("mz", "intensity", "line")
    gaps = peaks(spark, sf_dir).withColumn("gap", F.col("mz") - F.lag("mz").over(w)).filter("gap IS NOT NULL")
    sums = gaps.agg(F.count("gap").alias("n"), *[F.avg((F.col("gap") <= x).cast("int")).alias(str(x)) for x in (10, 50, 100, 250, 500)])
    long = sums.select("n", F.explode(F.array(*[F.struct(F.lit(x).alias("width"), F.col(str(x)).alias("inside")) for x in (10, 50, 100, 250, 500)])).alias("_s"))
    return long.select("_s.width", "n", ROUND("_s.inside").alias("inside"))


@register("f35_leakage", """WITH b AS (SELECT l_orderkey, l_linenumber, l_discount > 0.05 AS masked FROM lineitem WHERE l_returnflag = 'N'), c AS (SELECT DISTINCT l_orderkey, l_linenumber - 1 AS parent FROM lineitem WHERE l_returnflag <> 'N' AND l_discount <= 0.05)
  SELECT count(*) AS masked, count(parent) AS leaked, round(count(parent) / count(*), 6) AS share FROM b LEFT JOIN c ON c.l_orderkey = b.l_orderkey AND c.parent = b.l_linenumber WHERE masked""")
def f35(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    base = rows.filter("l_returnflag = 'N' AND l_discount > 0.05").select("l_orderkey", F.col("l_linenumber").alias("parent"))
    child = rows.filter("l_returnflag <> 'N' AND l_discount <= 0.05").select("l_orderkey", (F.col("l_linenumber") - 1).alias("parent")).distinct().withColumn("_c", F.lit(1))
    return base.join(child, ["l_orderkey", "parent"], "left").agg(F.count(F.lit(1)).alias("masked"), F.count("_c").alias("leaked"), ROUND(F.count("_c") / F.count(F.lit(1))).alias("share"))


@register("f38_loss_tallies", f"SELECT p_partkey % 7 AS class, len(regexp_extract_all(seq, '\\[[^\\]]*\\]')) AS modifications, count(*) AS n, round(stddev_pop(charge), 6) AS spread FROM {SEQ} GROUP BY 1, 2")
def f38(spark, sf_dir):
    rows = sequences(spark, sf_dir).select((F.col("p_partkey") % 7).alias("class"), F.regexp_count("seq", F.lit(r"\[[^\]]*\]")).cast("long").alias("modifications"), "charge")
    return rows.groupBy("class", "modifications").agg(F.count(F.lit(1)).alias("n"), ROUND(F.stddev_pop("charge")).alias("spread"))


@register("f39_pairs_by_site", f"{IONS} SELECT b.position AS site, count(*) AS n, round(avg(y.mz), 4) AS mean_mz FROM ions b JOIN ions y ON b.p_partkey = y.p_partkey JOIN (SELECT p_partkey, len(m) AS n FROM t) t ON t.p_partkey = b.p_partkey WHERE b.series = 'b' AND y.series = 'y' AND b.position + y.position = t.n GROUP BY 1")
def f39(spark, sf_dir):
    sites = G.complementary_pairs(ions(spark, sf_dir), "p_partkey")
    return sites.groupBy("site").agg(F.count(F.lit(1)).alias("n"), ROUND(F.avg("y"), 4).alias("mean_mz"))


@register("f30_resolvability", """SELECT name, width, CASE WHEN delta / width >= 2 THEN 'resolvable' WHEN delta / width >= 1 THEN 'marginal' ELSE 'unresolvable' END AS class, round(delta / width, 6) AS bins
  FROM (VALUES ('Gln-Lys', 0.036), ('Isotope (z=3)', 0.334), ('Isotope (z=2)', 0.502), ('H2O-NH3 loss', 0.984), ('Isotope (z=1)', 1.003), ('Gly-Ala', 14.016)) d(name, delta), (SELECT max(l_discount) AS width FROM lineitem UNION ALL SELECT max(l_tax) FROM lineitem) w""")
def f30(spark, sf_dir):
    differences = (("Gln-Lys", 0.036), ("Isotope (z=3)", 0.334), ("Isotope (z=2)", 0.502), ("H2O-NH3 loss", 0.984), ("Isotope (z=1)", 1.003), ("Gly-Ala", 14.016))
    widths = table(spark, sf_dir, "lineitem").agg(F.array(F.max("l_discount"), F.max("l_tax")).alias("_w")).select(F.explode("_w").alias("width"))
    rows = widths.withColumn("_d", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).alias("delta")) for n, d in differences])))
    bins = F.col("_d.delta") / F.col("width")
    return rows.select("_d.name", "width", F.when(bins >= 2, "resolvable").when(bins >= 1, "marginal").otherwise("unresolvable").alias("class"), ROUND(bins).alias("bins"))

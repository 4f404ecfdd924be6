"""Fragment ladders of the sequences, their pairs, gaps and matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequences import MODIFICATIONS, PROTON, RESIDUES, WATER
from ..operators import fragments as G
from ..operators.windows import band_pairs
from .catalog import register
from .strings import SEQ, masses, sequences

MASS = masses(RESIDUES | {f"[{k}]": v for k, v in MODIFICATIONS.items()})
IONS = f"""WITH t AS (SELECT p_partkey, list_transform(regexp_extract_all(seq, '(?:\\[[^\\]]*\\]-?)?[A-Z](?:\\[[^\\]]*\\])*'), lambda r: list_sum(list_transform(regexp_extract_all(r, '\\[[^\\]]*\\]|[A-Z]'), lambda x: {MASS}[x]))) AS m FROM {SEQ}),
  p AS (SELECT p_partkey, m, unnest(range(1, len(m)))::INT AS i FROM t),
  ions AS (SELECT p_partkey, 'b' AS series, i AS position, list_sum(m[:i]) + {PROTON} AS mz FROM p UNION ALL SELECT p_partkey, 'y', (len(m) - i)::INT, list_sum(m[i + 1:]) + {WATER} + {PROTON} FROM p)"""


def ions(spark, sf_dir, charge: int = 1):
    return G.ladder(sequences(spark, sf_dir), "p_partkey", "seq", charge)


@register("k17_fragment_ladder", f"{IONS} SELECT p_partkey, series, position, 1 AS charge, round(mz, 5) AS mz FROM ions")
def k17(spark, sf_dir):
    return ions(spark, sf_dir).withColumn("mz", F.round("mz", 5))


@register("k16_loss_variants", f"{IONS} SELECT loss, count(*) AS n, round(avg(mz - d), 4) AS mean_mz FROM ions, (VALUES ('H2O', {G.LOSSES['H2O']}), ('NH3', {G.LOSSES['NH3']})) v(loss, d) GROUP BY 1")
def k16(spark, sf_dir):
    return G.loss_variants(ions(spark, sf_dir), ["H2O", "NH3", "none"]).groupBy("loss").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mz"), 4).alias("mean_mz"))


@register("e19_complementary_pairs", f"{IONS} SELECT b.p_partkey, count(*) AS sites, round(avg(b.mz + y.mz - 2 * {PROTON}), 4) AS mass FROM ions b JOIN ions y ON b.p_partkey = y.p_partkey JOIN (SELECT p_partkey, len(m) AS n FROM t) t ON t.p_partkey = b.p_partkey WHERE b.series = 'b' AND y.series = 'y' AND b.position + y.position = t.n GROUP BY 1")
def e19(spark, sf_dir):
    return G.complementary_pairs(ions(spark, sf_dir), "p_partkey").groupBy("p_partkey").agg(F.count(F.lit(1)).alias("sites"), F.round(F.avg("mass"), 4).alias("mass"))


@register("e20_mass_gaps", f"{IONS} SELECT a.series, count(*) AS n, round(avg(abs(b.mz - a.mz)), 4) AS gap FROM ions a JOIN ions b ON a.p_partkey = b.p_partkey AND a.series = b.series AND b.position = a.position + 1 GROUP BY 1")
def e20(spark, sf_dir):
    return G.mass_gaps(ions(spark, sf_dir), "p_partkey").groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gap"), 4).alias("gap"))


@register("e12_matched_ions")
def e12(spark, sf_dir):
    """Ladders against themselves, shifted by 0.01: every ion within 0.02 matches one to one."""
    theory = ions(spark, sf_dir).select("p_partkey", F.concat("series", F.col("position").cast("string")).alias("ion"), "mz")
    seen = theory.select("p_partkey", F.col("ion").alias("peak"), (F.col("mz") + 0.01).alias("peak_mz"))
    pairs = band_pairs(theory, seen, ["p_partkey"], "mz", "peak_mz", 0.02).withColumn("error", F.round(F.abs(F.col("mz") - F.col("peak_mz")), 9))
    return G.greedy_match(pairs, ["p_partkey"], "ion", "peak", "error").groupBy("p_partkey").agg(F.count(F.lit(1)).alias("matched"))

"""Theoretical fragment ladders and their matches with observed peaks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import PROTON, WATER, neutral_mass

#: Neutral losses.
LOSSES = {"H2O": 18.0105647, "NH3": 17.0265491, "H3PO4": 97.9768957, "SO3": 79.9568154}
ISOTOPE = 1.003355


def residues(seq: Column) -> Column:
    """Residues with what is attached to them, the start's modification to the first."""
    return F.regexp_extract_all(seq, F.lit(r"((?:\[[^\]]*\]-?)?[A-Z](?:\[[^\]]*\])*)"), F.lit(1))


def ladder(df: DataFrame, key: str, seq: str, max_charge: int = 1) -> DataFrame:
    """key, series (b, y), position, charge, mz of all b and y ions; positions count residues from the ion's own end."""
    parts = df.select(key, F.posexplode(residues(F.col(seq))).alias("_i", "_r")).withColumn("_m", neutral_mass(F.col("_r")) - F.lit(WATER))
    group = Window.partitionBy(key)
    run = parts.withColumn("_b", F.sum("_m").over(group.orderBy("_i"))).withColumn("_t", F.sum("_m").over(group)).withColumn("_n", F.count(F.lit(1)).over(group))
    inner = run.filter(F.col("_i") < F.col("_n") - 1)
    b = F.struct(F.lit("b").alias("series"), (F.col("_i") + 1).cast("int").alias("position"), F.col("_b").alias("mass"))
    y = F.struct(F.lit("y").alias("series"), (F.col("_n") - F.col("_i") - 1).cast("int").alias("position"), (F.col("_t") - F.col("_b") + WATER).alias("mass"))
    ions = inner.select(key, F.explode(F.array(b, y)).alias("_x")).select(key, "_x.*")
    charged = ions.withColumn("charge", F.explode(F.array(*[F.lit(z) for z in range(1, max_charge + 1)])))
    return charged.select(key, "series", "position", "charge", (F.col("mass") / F.col("charge") + PROTON).alias("mz"))


def loss_variants(ions: DataFrame, losses: list[str]) -> DataFrame:
    """Ions less each known loss, at their charge; unknown names are left out."""
    known = [F.struct(F.lit(n).alias("loss"), F.lit(LOSSES[n]).alias("delta")) for n in losses if n in LOSSES]
    return ions.withColumn("_l", F.explode(F.array(*known))).withColumn("mz", F.col("mz") - F.col("_l.delta") / F.col("charge")).withColumn("loss", F.col("_l.loss")).drop("_l")


def isotope_variants(ions: DataFrame, most: int) -> DataFrame:
    return ions.withColumn("isotope", F.explode(F.array(*[F.lit(k) for k in range(1, most + 1)]))).withColumn("mz", F.col("mz") + ISOTOPE * F.col("isotope") / F.col("charge"))


def complementary_pairs(ions: DataFrame, key: str) -> DataFrame:
    """b_i with y_(n-i) at charge 1: one row per cleavage site, with both m/z and the sum of both neutral masses."""
    n = Window.partitionBy(key)
    one = ions.filter("charge = 1").withColumn("_n", F.max("position").over(n) + 1).withColumn("site", F.when(F.col("series") == "b", F.col("position")).otherwise(F.col("_n") - F.col("position")))
    pick = lambda s: F.max(F.when(F.col("series") == s, F.col("mz")))
    return one.groupBy(key, "site").agg(pick("b").alias("b"), pick("y").alias("y")).withColumn("mass", F.col("b") + F.col("y") - 2 * PROTON)


def mass_gaps(ions: DataFrame, key: str) -> DataFrame:
    """Distance of each ion to the next of its series and charge, as a neutral mass."""
    w = Window.partitionBy(key, "series", "charge").orderBy("position")
    after = ions.withColumn("_p", F.lead("position").over(w)).withColumn("_z", F.lead("mz").over(w))
    return after.filter(F.col("_p") == F.col("position") + 1).select(key, "series", "charge", "position", (F.abs(F.col("_z") - F.col("mz")) * F.col("charge")).alias("gap"))


def greedy_match(pairs: DataFrame, by: list[str], left: str, right: str, cost: str) -> DataFrame:
    """One-to-one pairs of each group, cheapest first; ties by left, then right. Groups pass in their order, a task holds the ids used in one group."""
    order = Window.partitionBy(*by).orderBy(*[F.col(c).asc_nulls_last() for c in (cost, left, right)])

    def run(batches):
        used_l, used_r = set(), set()
        for batch in batches:
            keep = []
            for i, (n, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_n", left, right)), strict=True)):
                if n == 1:
                    used_l, used_r = set(), set()
                if a not in used_l and b not in used_r:
                    used_l.add(a)
                    used_r.add(b)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(names)

    names = pairs.columns
    return pairs.withColumn("_n", F.row_number().over(order)).mapInArrow(run, pairs.schema)

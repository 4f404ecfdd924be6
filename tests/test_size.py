"""What must hold whatever the size of a table: no side of an ion is broadcast, no group is one task's."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spectraloom.operators import fragments, rank, windows
from spectraloom.plans import load

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["e12_matched_ions", "e18_charge_variants", "f39_pairs_by_site"])
def test_ladders_are_not_broadcast(spark, name):
    # the planner takes a ladder for as small as its table
    assert "BroadcastExchange" not in plan(load().QUERIES[name](spark, DATA))


def test_band_pairs_against_brute_force(spark):
    rng = random.Random(5)
    side = lambda n: [(rng.choice([1, 2, 3, None]), i, rng.choice([None, rng.randrange(40) / 4, -rng.random(), 1e6 + rng.randrange(3) / 4])) for i in range(n)]
    left, right = side(90), side(70)
    out = windows.band_pairs(spark.createDataFrame(left, "g int, i int, x double"), spark.createDataFrame(right, "g int, j int, y double"), ["g"], "x", "y", 0.25)
    assert out.columns == ["g", "i", "x", "j", "y"]
    want = sorted((g, i, j) for g, i, x in left for h, j, y in right if g is not None and g == h and x is not None and y is not None and abs(x - y) <= 0.25)
    assert sorted((r.g, r.i, r.j) for r in out.collect()) == want and len(want) > 50


def test_greedy_match_across_batches(spark):
    """Groups pass in batches of three rows; ids that one group used are free in the next."""
    rng = random.Random(6)
    rows = [(g, f"l{rng.randrange(5)}", rng.randrange(5), rng.randrange(6) / 2) for g in [None, *range(30)] for _ in range(12)]
    want = []
    for g in {r[0] for r in rows}:
        used_l, used_r = set(), set()
        for _, a, b, c in sorted((r for r in rows if r[0] == g), key=lambda r: (r[3], r[1], r[2])):
            if a not in used_l and b not in used_r:
                used_l.add(a)
                used_r.add(b)
                want.append((g, a, b, c))
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, 3)
    try:
        out = fragments.greedy_match(spark.createDataFrame(rows, "g int, l string, r int, c double"), ["g"], "l", "r", "c").collect()
    finally:
        spark.conf.set(batch, before)
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)


def test_sites_have_both_ions(spark):
    ions = fragments.ladder(spark.createDataFrame([(1, "GASP")], "k int, s string"), "k", "s")
    by = {(r.series, r.position): r.mz for r in ions.collect()}
    out = fragments.complementary_pairs(ions, "k").orderBy("site").collect()
    assert [(r.site, r.b, r.y) for r in out] == [(i, by["b", i], by["y", 4 - i]) for i in (1, 2, 3)]


@pytest.mark.parametrize("size", [40, 10**9])
def test_percent_ranks_of_cut_groups(spark, monkeypatch, size):
    """Frequent values, nulls, a null group and small groups, with groups cut and not."""
    monkeypatch.setattr(rank, "CUT_ROWS", size)
    rng = random.Random(7)
    rows = [(g, i, rng.choice([None, 1.0, 2.0, rng.random(), float("nan")]), rng.choice([0.1, 0.2]), rng.gauss(0, 1) ** 9) for g, n in ((1, 900), (2, 300), (None, 200), (3, 7), (4, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, i int, a double, b double, c double")
    want = {(r.g, r.i): tuple(r[2:]) for r in df.select("g", "i", *[rank.percent_rank_average(F.col(c), ["g"]) for c in "abc"]).collect()}
    out = rank.percent_ranks(df, ["g"], ["a", "b", "c"])
    assert {(r.g, r.i): (r.a, r.b, r.c) for r in out.collect()} == want and len(want) == len(rows)


def test_large_groups_are_not_sorted_whole(spark, monkeypatch):
    monkeypatch.setattr(rank, "CUT_ROWS", 100)
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 4001).cast("double").alias("v"), (F.col("id") % 3).cast("double").alias("w"))
    out = rank.percent_ranks(df, ["g"], ["v", "w"])
    text = plan(out)
    # one shuffle, by group and bucket, for v; none for the three values of w
    assert text.count("Exchange hashpartitioning(") == 1 and "hashpartitioning(g#" in text and ", _g#" in text
    assert out.agg(F.sum("v")).first()[0] == pytest.approx(2000)


def test_quantiles_against_percentile(spark):
    rng = random.Random(8)
    qs = [0.0, 0.02, 0.5, 0.9, 0.98, 1.0]
    for values in ([3.0], [1.0, 2.0], [rng.random() for _ in range(999)], [rng.gauss(0, 1) ** 31 for _ in range(500)] + [None, 1e308, -1e308], [0.5] * 90 + [0.25] * 10, [rng.choice([float("inf"), -float("inf"), 1.0, 2.0]) for _ in range(50)]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = rank.quantiles(df, "v", qs).first()[0]
        order = sorted(v for v in values if v is not None)
        for q, x in zip(qs, got, strict=True):
            at = (len(order) - 1) * q
            a, b = order[math.floor(at)], order[math.ceil(at)]
            assert x == (a if a == b else pytest.approx(a + (b - a) * (at - math.floor(at)), nan_ok=True))
    assert rank.quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]).count() == 1
    assert " percentile(" not in plan(rank.tiers(spark.range(9).withColumn("score", F.col("id") / 9)))


@pytest.mark.parametrize("name", ["g2_tiers", "g3_filtered_tier"])
def test_tiers_do_not_gather_all_scores(spark, name):
    assert " percentile(" not in plan(load().QUERIES[name](spark, DATA)).replace("[", " ")


@pytest.mark.parametrize("name", ["g2_tiers", "g3_filtered_tier"])
def test_scores_are_made_once(spark, name):
    df = load().QUERIES[name](spark, DATA)
    df.collect()
    final = plan(df).partition("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final


@pytest.mark.parametrize("size", [3, 40, 10**6])
@pytest.mark.parametrize("copies", [1, 20])
def test_composite_counts(spark, monkeypatch, size, copies):
    """Equal rows ranked as one and each by itself, with groups cut, looked up and whole: the ranks of all rows."""
    monkeypatch.setattr(rank, "CUT_ROWS", size)
    monkeypatch.setattr(rank, "SLICE", 1)
    rng = random.Random(9)
    rows = [(g, rng.choice([None, 1.0, rng.random(), float("nan")]), rng.choice([0.1, 0.2, None]), rng.gauss(0, 1) ** 9) for g, n in ((1, 400), (2, 90), (None, 150), (3, 7), (4, 1)) for i in range(n)]
    rows += rows[::3]
    df = spark.createDataFrame(rows * copies, "g int, a double, b double, c double")
    parts = [F.col("a"), F.col("b"), 1 - F.col("c")]
    score = sum((rank.percent_rank_average(x, ["g"]) for x in parts), F.lit(0.0)) / 3
    want = {(r.g, r.s): r["count"] for r in df.select("g", F.round(score, 9).alias("s")).groupBy("g", "s").count().collect()}
    out = rank.composite_counts(df, ["g"], parts, 9).collect()
    assert {(r.g, r.score): r.n for r in out} == want and len(out) == len(want) and sum(want.values()) == len(rows) * copies


def test_equal_rows_are_ranked_as_one(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("g"), (F.col("id") % 300).cast("double").alias("v"))
    out = rank.composite_counts(df, ["g"], [F.col("v")], 9)
    text = plan(out)
    # rows are counted below all windows
    assert text.rindex("partial_count(1)") > text.rindex("Window ")
    assert out.count() == 300 and {r.n for r in out.collect()} == {20}


def test_quantiles_of_counts(spark):
    df = spark.createDataFrame([(3.0, 2), (1.0, 1), (3.0, 3), (None, 9), (8.0, 4)], "v double, n long")
    values = spark.createDataFrame([(v,) for v in [1.0] + [3.0] * 5 + [8.0] * 4], "v double")
    qs = [0.0, 0.05, 0.5, 0.6, 1.0]
    assert rank.quantiles(df, "v", qs, weight="n").first()[0] == rank.quantiles(values, "v", qs).first()[0]

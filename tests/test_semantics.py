"""Hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from spectraloom.functions import sequences as S
from spectraloom.operators import clean, metrics, splits, windows
from spectraloom.operators.rank import percent_rank_average


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_percent_rank_ties_and_singleton(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 4.0), ("b", 7.0), ("b", None)], "g string, v double")
    got = sorted((r.g, r.v is None, r.p) for r in df.select("g", "v", percent_rank_average(F.col("v"), ["g"]).alias("p")).collect())
    assert [p for _, _, p in got] == [0.0, 0.5, 0.5, 1.0, 0.5, 0.5]


def test_null_policies(spark):
    df = spark.createDataFrame([(None,), (0,), (7,), (8,)], "charge int")
    lit = [F.lit(1.0)] * 2
    assert df.filter(clean.quality_labelled(*lit, F.col("charge"), F.lit(1.0), F.lit("A"))).count() == 3
    assert df.filter(clean.quality_unlabelled(*lit, F.col("charge"), F.lit(1.0))).count() == 2
    with pytest.raises(ValueError):
        clean.nullable_filter(F.col("charge"), "<", 1)


def test_sequences(spark):
    assert one(spark, S.registry_key(F.lit("PEPTIDEIK"))) == "PEPTLDELK"
    assert one(spark, S.strip_modifications(F.lit("[UNIMOD:1]-C[UNIMOD:4]A(x)I"))) == "CAI"
    assert one(spark, S.isolation_from_header(F.lit("MS2 scan 1234.5@30.0"))) == 1234.5
    assert one(spark, S.neutral_mass(F.lit("AX"))) is None
    assert one(spark, S.distance_bin(F.lit(4), [0, 1, 2, 3, 5])) == "d>=5"
    assert one(spark, S.token_distance(S.tokens(F.lit("AC[UNIMOD:4]K")), S.tokens(F.lit("ACK")))) == 1


def test_deficits(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(10)], "key string")
    history = spark.createDataFrame([(f"k{i}", "train") for i in range(9)], "key string, split string")
    assert [r.split for r in splits.assign_new(keys, history, "key").collect()] == ["valid"]


def test_runs_gaps_and_precision(spark):
    df = spark.createDataFrame([(1, p) for p in (3, 4, 5, 7, 8)], "g int, p int")
    assert windows.longest_run(df, ["g"], "p").first().longest == 3
    gaps = spark.createDataFrame([(1, 100.0, "u"), (1, 110.0, "m"), (1, 125.0, "u")], "g int, mz double, k string")
    r = windows.nearest_gaps(gaps, ["g"], "mz", F.col("k") == "m", F.col("k") == "u").first()
    assert (r.left_gap, r.right_gap, r.nearest_gap, r.total_gap) == (10, 15, 10, 25)
    hits = spark.createDataFrame([(1, 1, True, 2), (1, 2, False, 2), (1, 3, True, 2)], "q int, rank int, same boolean, total int")
    assert round(metrics.average_precision(hits, "q", "same", "total").first().ap, 4) == 0.8333


def test_calibration_edge(spark):
    df = spark.createDataFrame([(0.0, True), (1.0, True)], "c double, ok boolean")
    assert metrics.expected_calibration_error(df, "c", F.col("ok")).first().ece == 0.0


def test_without_training_data_operators(spark):
    import __spark_entry__

    assert set(load_names()) <= set(__spark_entry__.queries())


def load_names():
    from spectraloom.plans import load

    return load().QUERIES


def test_greedy_match_takes_cheapest_first(spark):
    from spectraloom.operators.fragments import greedy_match

    pairs = spark.createDataFrame([(1, "a", "x", 0.2), (1, "a", "y", 0.1), (1, "b", "y", 0.15), (1, "b", "x", 0.3), (2, "a", "x", 0.0)], "s int, l string, r string, c double")
    got = sorted((r.s, r.l, r.r) for r in greedy_match(pairs, ["s"], "l", "r", "c").collect())
    assert got == [(1, "a", "y"), (1, "b", "x"), (2, "a", "x")]

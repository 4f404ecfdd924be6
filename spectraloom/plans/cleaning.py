"""Filters, schema operators and audits of nulls and casts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean
from .catalog import register, table

#: lineitem as spectra: each seventh charge is null.
SPECTRA = """(SELECT l_orderkey, l_linenumber, l_extendedprice / 50 AS mz, l_quantity * 250 AS rt, l_discount * 4000 AS lower_offset,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_linenumber + l_suppkey % 3 - 1 END AS charge, l_returnflag || CASE WHEN l_suppkey % 5 = 0 THEN '[IN:12]' ELSE '[UNIMOD:4]' END AS sequence FROM lineitem)"""


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 50).alias("mz"), (F.col("l_quantity") * 250).alias("rt"), (F.col("l_discount") * 4000).alias("lower_offset"),
        F.when(F.col("l_partkey") % 7 == 0, F.lit(None)).otherwise(F.col("l_linenumber") + F.col("l_suppkey") % 3 - 1).alias("charge"),
        F.concat("l_returnflag", F.when(F.col("l_suppkey") % 5 == 0, "[IN:12]").otherwise("[UNIMOD:4]")).alias("sequence"),
    )


@register("c1_nullable_filter", f"SELECT count(*) AS n, count(charge) AS charged FROM {SPECTRA} WHERE charge IS NULL OR charge <= 3")
def c1(spark, sf_dir):
    return spectra(spark, sf_dir).filter(clean.nullable_filter(F.col("charge"), "<=", 3)).agg(F.count(F.lit(1)).alias("n"), F.count("charge").alias("charged"))


@register("c2_quality_labelled", f"""SELECT charge, count(*) AS n FROM {SPECTRA} WHERE (rt IS NULL OR rt <= 10800) AND (lower_offset IS NULL OR lower_offset <= 300)
  AND (charge IS NULL OR charge BETWEEN 0 AND 7) AND (mz IS NULL OR mz <= 2000) AND NOT regexp_matches(coalesce(sequence, ''), '\\[[Ii][Nn]:\\d+\\]') GROUP BY 1""")
def c2(spark, sf_dir):
    rows = spectra(spark, sf_dir).filter(clean.quality_labelled(*[F.col(c) for c in ("rt", "lower_offset", "charge", "mz", "sequence")]))
    return rows.groupBy("charge").agg(F.count(F.lit(1)).alias("n"))


@register("c3_quality_unlabelled", f"SELECT charge, count(*) AS n FROM {SPECTRA} WHERE rt <= 10800 AND lower_offset <= 300 AND charge BETWEEN 0 AND 7 AND mz <= 2000 GROUP BY 1")
def c3(spark, sf_dir):
    return spectra(spark, sf_dir).filter(clean.quality_unlabelled(*[F.col(c) for c in ("rt", "lower_offset", "charge", "mz")])).groupBy("charge").agg(F.count(F.lit(1)).alias("n"))


@register("c4_glyco_codes", f"SELECT regexp_matches(coalesce(sequence, ''), '\\[[Ii][Nn]:\\d+\\]') AS glyco, count(*) AS n FROM {SPECTRA} GROUP BY 1")
def c4(spark, sf_dir):
    from ..functions.sequences import has_glyco_code

    return spectra(spark, sf_dir).groupBy(has_glyco_code(F.col("sequence")).alias("glyco")).agg(F.count(F.lit(1)).alias("n"))


@register("c5_without_glyco", f"SELECT count(*) AS n FROM {SPECTRA} WHERE NOT regexp_matches(coalesce(sequence, ''), '\\[[Ii][Nn]:\\d+\\]')")
def c5(spark, sf_dir):
    from ..functions.sequences import has_glyco_code

    return spectra(spark, sf_dir).filter(~has_glyco_code(F.col("sequence"))).agg(F.count(F.lit(1)).alias("n"))


@register("c8_conditional_filter", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority::VARCHAR LIKE '1%' GROUP BY 1")
def c8(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return clean.conditional(orders, {"o_orderstatus": ["F", "O"]}).filter(F.col("o_orderpriority").startswith("1")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@register("c11_having_gate", """SELECT l_suppkey, round(100.0 * count_if(l_returnflag = 'R') / count(*), 6) AS rate, count(*) AS n FROM lineitem GROUP BY 1
  HAVING 100.0 * count_if(l_returnflag = 'R') / count(*) < 33 AND count(*) > 0""")
def c11(spark, sf_dir):
    rate = 100.0 * F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1))
    report = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(rate.alias("_r"), F.count(F.lit(1)).alias("n"))
    return report.filter((F.col("_r") < 33) & (F.col("n") > 0)).select("l_suppkey", F.round("_r", 6).alias("rate"), "n")


@register("c12_eligibility", """SELECT CASE WHEN b < 5 THEN 'too_few_base' WHEN m < 3 THEN 'too_few_modified' WHEN g < 10 THEN 'too_few_negatives' ELSE 'eligible' END AS reason, count(*) AS n
  FROM (SELECT l_partkey, count_if(l_returnflag = 'N')::BIGINT AS b, count_if(l_returnflag = 'R')::BIGINT AS m, count(DISTINCT l_suppkey) AS g FROM lineitem GROUP BY 1) GROUP BY 1""")
def c12(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("b"), F.count_if(F.col("l_returnflag") == "R").alias("m"), F.countDistinct("l_suppkey").alias("g"))
    reason = clean.first_failing([("too_few_base", F.col("b") < 5), ("too_few_modified", F.col("m") < 3), ("too_few_negatives", F.col("g") < 10)])
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@register("c14_conformance", f"SELECT count_if(rt > 10800)::BIGINT AS rt_bad, count_if(lower_offset > 300)::BIGINT AS offset_bad, count_if(charge NOT BETWEEN 0 AND 7)::BIGINT AS charge_bad, count_if(charge IS NULL)::BIGINT AS charge_null, count(*) AS n FROM {SPECTRA}")
def c14(spark, sf_dir):
    return spectra(spark, sf_dir).agg(
        F.count_if(F.col("rt") > 10800).alias("rt_bad"), F.count_if(F.col("lower_offset") > 300).alias("offset_bad"), F.count_if(~F.col("charge").between(0, 7)).alias("charge_bad"),
        F.count_if(F.col("charge").isNull()).alias("charge_null"), F.count(F.lit(1)).alias("n"),
    )


@register("d1_align", "SELECT c_custkey AS id, c_mktsegment AS segment, NULL::DOUBLE AS score, c_nationkey AS nation FROM customer")
def d1(spark, sf_dir):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("segment", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("nation", T.IntegerType())])
    return clean.align(table(spark, sf_dir, "customer"), schema, {"c_custkey": "id", "c_mktsegment": "segment", "c_nationkey": "nation"})


@register("d3_lenient_cast", "SELECT count_if(v IS NULL)::BIGINT AS nulls, round(sum(v), 4) AS total FROM (SELECT TRY_CAST(nullif(CASE WHEN event_id % 5 = 0 THEN 'Unknown' WHEN event_id % 7 = 0 THEN 'x' ELSE (event_id % 100)::VARCHAR END, 'Unknown') AS DOUBLE) AS v FROM events)")
def d3(spark, sf_dir):
    raw = F.when(F.col("event_id") % 5 == 0, "Unknown").when(F.col("event_id") % 7 == 0, "x").otherwise((F.col("event_id") % 100).cast("string"))
    rows = clean.sentinel_to_null(table(spark, sf_dir, "events").select(raw.alias("v")), ["v"]).select(F.col("v").try_cast("double").alias("v"))
    return rows.agg(F.count_if(F.col("v").isNull()).alias("nulls"), F.round(F.sum("v"), 4).alias("total"))


@register("d4_cast_losses", "SELECT 'p_name' AS \"column\", count_if(p_name IS NOT NULL AND TRY_CAST(p_name AS DOUBLE) IS NULL)::BIGINT AS lost, 0::BIGINT AS moved FROM part UNION ALL SELECT 'p_retailprice', 0, count_if(p_retailprice::FLOAT::DOUBLE <> p_retailprice)::BIGINT FROM part")
def d4(spark, sf_dir):
    return clean.cast_losses(table(spark, sf_dir, "part"), {"p_name": "double", "p_retailprice": "float"})


@register("d5_sentinel", "SELECT o_orderstatus AS status, count(*) AS n FROM (SELECT nullif(o_orderstatus, 'P') AS o_orderstatus FROM orders) GROUP BY 1")
def d5(spark, sf_dir):
    return clean.sentinel_to_null(table(spark, sf_dir, "orders"), ["o_orderstatus"], "P").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register("d6_blank_coalesce", "SELECT coalesce(CASE WHEN event_type IN ('', 'None', 'nan', 'NaN') OR event_id % 3 = 0 THEN NULL ELSE event_type END, 'user' || user_id::VARCHAR) AS name, count(*) AS n FROM events GROUP BY 1")
def d6(spark, sf_dir):
    name = F.coalesce(clean.blank_to_null(F.when(F.col("event_id") % 3 == 0, F.lit("None")).otherwise(F.col("event_type"))), F.concat(F.lit("user"), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))


@register("a10_in_values", "SELECT count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def a10(spark, sf_dir):
    return clean.in_values(table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.count(F.lit(1)).alias("n"))

"""Mixing sources to target weights with hash-threshold histograms.

Every row gets a uniform hash. Tokens are summed by source and hash bucket; the
running sum of a source's buckets shows in which bucket its budget ends; only
that bucket is looked at again, with the next bits of the hash, and at last hash
by hash. What remains is one threshold per source, and the mix is a filter on
it: rows are never sorted. Thresholds nest: the rows of a smaller budget are
among those of a larger one.

Defined results: null or empty text has size 0 and gets taken 0; a null source is
a source of its own, ranked last; rows have the hash of their id and text, so that
rows without an id, or with one id, are told apart; of rows that are equal in both,
as many are taken as come nearest to the target; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, hash60, materialize, word_count

#: Bits of the hash by level; what is left of its 60 bits is the last level.
LEVELS = (12, 12)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3, share: float = 1.0) -> DataFrame:
    """Targets of sources: (source, source_size) -> + target.

    Sources by code point, null last, take the weights in turn. A target stops at
    cap times the source's size; the excess goes to the others by weight until
    none is above. That ends at min(weight * level, cap * size) with one level for
    all, found by going through the sources in the order in which they fill up.
    One row a source: this table is as small as the list of sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    fills = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    after = fills.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    steps = (
        ranked.withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
        .withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
        .withColumn("_end", F.min(F.when(F.col("_fits"), F.col("_level"))).over(everything))
        .withColumn("_first", F.min(F.when(F.col("_fits"), F.col("_cap") / F.col("_w"))).over(everything))
    )
    level = F.max(F.when(F.col("_fits") & (F.col("_cap") / F.col("_w") == F.col("_first")), F.col("_level"))).over(everything)
    return steps.withColumn("_level", level).select(
        "source",
        "source_size",
        F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_w") * F.col("_level"), F.col("_cap"))).alias("target"),
    )


def _crossing(hist: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """The first bucket of each source in which the running sum passes the budget, with the sum before it. A source has at most 2 ** bits buckets."""
    w = Window.partitionBy("source").orderBy(bucket)
    run = hist.withColumn("_end", F.col("_before") + F.sum("_s").over(w)).withColumn("_start", F.col("_end") - F.col("_s"))
    past = run.filter(F.col("_end") > F.col("_rest")).withColumn("_i", F.row_number().over(w)).filter("_i = 1")
    return past.select("source", *keys, bucket, F.col("_start").alias("_before"), "_rest", F.col("_s").alias("_group"))


def thresholds(rows: DataFrame, budgets: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(source, size, h) and (source, _rest) -> (source, threshold): rows with h below it hold about _rest tokens of their source.

    The row at the boundary belongs to the mix if that comes nearer to the budget. With a
    column r, rows of one hash are told apart by it: + tie, under which r must be where h is the threshold.
    """
    shift, keys = 60, []
    every, edge = rows, budgets.select("source", "_rest", F.lit(0).cast("long").alias("_before"))
    for bits in (*levels, shift - sum(levels)):
        shift -= bits
        on = [rows["source"].eqNullSafe(edge["source"])]
        cells = rows
        if keys:
            on.append(rows[keys[-1]] == edge[keys[-1]])
        cells = rows.withColumn(f"_b{shift}", F.shiftright("h", shift))
        on = [cells["source"].eqNullSafe(edge["source"])] + [cells[k] == edge[k] for k in keys[-1:]]
        if keys:
            hist = cells.join(edge, on, "inner").groupBy(edge["source"], edge["_rest"], edge["_before"], f"_b{shift}").agg(F.sum("size").alias("_s"))
        else:
            summed = cells.groupBy("source", f"_b{shift}").agg(F.sum("size").alias("_s"))
            hist = summed.join(edge, summed["source"].eqNullSafe(edge["source"])).select(edge["source"], "_rest", "_before", f"_b{shift}", "_s")
        edge = _crossing(hist, [], f"_b{shift}")
        rows = cells
        keys.append(f"_b{shift}")
    inside = 2 * F.col("_before") + F.col("_group") <= 2 * F.col("_rest")
    if "r" not in every.columns:
        return edge.select("source", (F.col(keys[-1]) + inside.cast("long")).alias("threshold"))
    # rows of the boundary's hash go by a second one
    edge = materialize(edge.select("source", F.col(keys[-1]).alias("threshold"), (F.col("_rest") - F.col("_before")).alias("_rest")), "mix-edges")
    ties = every.join(edge.select(F.col("source").alias("_of"), "threshold"), F.col("source").eqNullSafe(F.col("_of")) & (F.col("h") == F.col("threshold"))).select("source", "size", F.col("r").alias("h"))
    ties = materialize(ties, "mix-ties")
    second = thresholds(ties, edge.select("source", "_rest"), levels).select(F.col("source").alias("_of"), F.col("threshold").alias("tie"))
    return edge.join(second, edge["source"].eqNullSafe(second["_of"]), "left").select("source", "threshold", F.coalesce("tie", F.lit(0).cast("long")).alias("tie"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, share: float = 1.0, seed: str = "mix", carry: bool = False,
) -> DataFrame:
    """One row per input row: id, size, source_size, target, copies, taken = size * copies; carry: + row, the whole input row.

    A source whose target is r times its size and a rest gives every row r times,
    and the rows under the threshold of the rest once more; so no row is taken
    more than cap times. The slim table (id, source, size, hash) is written once
    in the shared folder; the text is read once.
    """
    slim = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), hash60(F.lit(seed), F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("h"),
        # numbers the rows of this table; tells equal rows apart, which of them does not matter
        F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 4).alias("r"), *([F.struct(*docs.columns).alias("row")] if carry else []),
    )
    slim = materialize(slim, "mix")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = materialize(
        source_targets(sizes, weights, cap, share)
        .withColumn("_r", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("_rest", F.col("target") - F.col("_r") * F.col("source_size")),
        "mix-sources",
    )
    cut = thresholds(slim.select("source", "size", "h", "r"), plan.filter("_rest > 0").select("source", "_rest"))
    full = plan.join(cut, plan["source"].eqNullSafe(cut["source"]), "left").select(plan["*"], *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("threshold", "tie")])
    full = materialize(full, "mix-thresholds")
    out = slim.join(full, slim["source"].eqNullSafe(full["source"]), "inner")
    copies = F.col("_r") + ((F.col("h") < F.col("threshold")) | ((F.col("h") == F.col("threshold")) & (F.col("r") < F.col("tie")))).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *(["row"] if carry else []))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
r AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         source_size * 3.0::DOUBLE AS cap
  FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.0::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
t AS (
  SELECT source, source_size, least(w * (SELECT arg_min(level, cap / w) FROM l WHERE level * w <= cap), cap) AS target FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS r FROM t),
g AS (
  SELECT d.source, d.h, sum(size)::BIGINT AS s, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY d.h) - sum(size) AS before
  FROM d GROUP BY 1, 2),
x AS (
  SELECT g.source, g.h, 2 * g.before + g.s <= 2 * (p.target - p.r * p.source_size) AND p.target - p.r * p.source_size > 0 AS extra
  FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, d.size, p.source_size, p.target, d.size * (p.r + CASE WHEN extra THEN 1 ELSE 0 END) AS taken,
       p.r + CASE WHEN extra THEN 1 ELSE 0 END AS copies
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h
"""

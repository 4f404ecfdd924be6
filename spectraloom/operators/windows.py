"""Islands, nearest neighbours along an axis, ladders and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_gaps(df: DataFrame, by: list[str], x: str, target: Column, source: Column) -> DataFrame:
    """For target rows, distances to the nearest source row on the left and right along x: + left_gap, right_gap, nearest_gap, total_gap."""
    w = Window.partitionBy(*by).orderBy(x)
    value = F.when(source, F.col(x))
    left = F.col(x) - F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)) - F.col(x)
    out = df.withColumn("left_gap", left).withColumn("right_gap", right).filter(target)
    return out.withColumn("nearest_gap", F.least("left_gap", "right_gap")).withColumn("total_gap", F.col("left_gap") + F.col("right_gap"))


def islands(df: DataFrame, by: list[str], order: list[str], flag: Column) -> DataFrame:
    """Rows of runs of a true flag, + island (number of its run in the group's order)."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("_f", flag)
    return marked.withColumn("island", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*by, "_f").orderBy(*order))).filter("_f").drop("_f")


def longest_run(df: DataFrame, by: list[str], position: str) -> DataFrame:
    """Longest run of consecutive whole numbers per group."""
    distinct = df.select(*by, position).distinct()
    w = Window.partitionBy(*by).orderBy(position)
    runs = distinct.withColumn("_i", F.col(position) - F.row_number().over(w)).groupBy(*by, "_i").agg(F.count(F.lit(1)).alias("_n"))
    return runs.groupBy(*by).agg(F.max("_n").alias("longest"))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows of each group; order must end in a unique key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def band_join(left: DataFrame, right: DataFrame, by: list[str], x: str, y: str, tolerance: float) -> DataFrame:
    """Pairs with |x - y| <= tolerance, by cells of the tolerance's width: an equi-join on the cell and its neighbours."""
    width = max(tolerance, 1e-9)
    cells = left.withColumn("_cell", F.explode(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.floor(F.col(x) / width) + d)))
    other = right.withColumn("_cell", F.floor(F.col(y) / width))
    return cells.join(other, [*by, "_cell"]).drop("_cell").filter(F.abs(F.col(x) - F.col(y)) <= tolerance)


def band_pairs(left: DataFrame, right: DataFrame, by: list[str], x: str, y: str, tolerance: float) -> DataFrame:
    """band_join for groups that are one spectrum each: a shuffle by the group, then a frame along the axis holds the right rows of each left row's band.

    No side is copied into cells and none is broadcast, whatever the planner takes their size to be.
    """
    # a little more than the tolerance, for what is lost by the division
    width = max(tolerance, 1e-9) * 1.001
    sides = []
    for df, c, name in ((left, x, "_l"), (right, y, "_r")):
        known = df.filter(F.col(c).isNotNull()).dropna(subset=by)
        sides.append(known.select(*by, (F.col(c) / width).cast("double").alias("_x"), F.struct(*[F.col(n) for n in df.columns if n not in by]).alias(name)))
    rows = sides[0].unionByName(sides[1], allowMissingColumns=True)
    near = F.collect_list("_r").over(Window.partitionBy(*by).orderBy("_x").rangeBetween(-1, 1))
    pairs = rows.withColumn("_n", near).filter("_l IS NOT NULL").select(*by, "_l", F.explode("_n").alias("_r")).select(*by, "_l.*", "_r.*")
    return pairs.filter(F.abs(F.col(x) - F.col(y)) <= tolerance)

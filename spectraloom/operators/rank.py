"""Ranks within groups, composite scores and tiers."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(value: Column, weight: str | None) -> Column:
    """Non-null values; a row counts as often as its weight says."""
    return F.count(value) if weight is None else F.sum(F.when(value.isNotNull(), F.col(weight)).otherwise(F.lit(0)))


def _rank(value: Column, by: list[str], weight: str | None) -> Column:
    """The first rank of a value that is not null, from 1."""
    order = Window.partitionBy(*by).orderBy(value.asc_nulls_last())
    return F.rank().over(order) if weight is None else _number(value, weight).over(order) - _number(value, weight).over(Window.partitionBy(*by, value)) + 1


def percent_rank_average(value: Column, by: list[str], weight: str | None = None) -> Column:
    """(r - 1) / (n - 1) with average ranks for ties, n the non-null values of the group; 0.5 for null and for a group of one."""
    n = _number(value, weight).over(Window.partitionBy(*by))
    rank = _rank(value, by, weight) + (_number(value, weight).over(Window.partitionBy(*by, value)) - 1) / 2
    return F.when(value.isNull() | (n <= 1), F.lit(0.5)).otherwise((rank - 1) / (n - 1))


#: Rows that a cut of a group stands for, and the most cuts of a group (a binary search of 8 steps).
CUT_ROWS, CUTS = 50_000, 255

#: Of the hashes of rows, one in so many is counted to learn how many differ. Such estimates choose a way and change no result.
SLICE = 64


def _differing(df: DataFrame, kinds: list[list[str]]) -> list[tuple[int, int]]:
    """For each list of columns: about how many rows differ in them, and how many rows there are to each. A few numbers are collected."""
    hashes = [df.select(F.lit(i).alias("_i"), F.xxhash64(*cols).alias("_h")).filter(F.col("_h").bitwiseAND(SLICE - 1) == 0) for i, cols in enumerate(kinds)]
    counts = reduce(DataFrame.union, hashes).groupBy("_i", "_h").count()
    sizes = {i: (SLICE * n, rows // n) for i, n, rows in counts.groupBy("_i").agg(F.count(F.lit(1)), F.sum("count")).collect()}
    return [sizes.get(i, (0, SLICE)) for i in range(len(kinds))]


def _cuts(df: DataFrame, by: list[str], cols: list[str]) -> list:
    """Rows of groups that are cut: by, and for each column its cuts, in order. No more than rows / CUT_ROWS of each column in all; where they lie changes no result."""
    k = F.least(F.lit(CUTS).cast("long"), F.floor(F.col("_n") / CUT_ROWS))
    quantiles = [F.percentile_approx(c, [j / (CUTS + 1) for j in range(1, CUTS + 1)], 10_000).alias(c) for c in cols]
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *quantiles).filter(F.col("_n") >= CUT_ROWS).withColumn("_k", k)

    def kept(c: str) -> Column:
        places = F.sequence(F.lit(1).cast("long"), F.col("_k"))
        return F.transform(places, lambda j: F.get(F.col(c), F.floor(j * (CUTS + 1) / (F.col("_k") + 1)).cast("int") - 1)).alias(c)

    return groups.select(*by, *[kept(c) for c in cols]).collect()


def _with_table(df: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    same = [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)]
    return df.join(F.broadcast(table), on=same or F.lit(True), how="left").drop(*[f"_b{i}" for i in range(len(by))])


def _with_codes(df: DataFrame, cols: list[str]) -> DataFrame:
    """+ _k_<c>: twice the number of cuts below the value, and 1 more for a value that is two cuts at least; null for null values and in groups without cuts."""
    df = df.withColumns({f"_k_{c}": F.when(F.col(c).isNotNull() & F.col(f"_cuts_{c}").isNotNull(), F.lit(0)) for c in cols})
    step = (CUTS + 1) // 2
    while step:
        df = df.withColumns({f"_k_{c}": F.col(f"_k_{c}") + F.when(F.get(f"_cuts_{c}", F.col(f"_k_{c}") + (step - 1)) < F.col(c), F.lit(step)).otherwise(F.lit(0)) for c in cols})
        step //= 2
    at = lambda c, d: F.coalesce(F.get(f"_cuts_{c}", F.col(f"_k_{c}") + d) == F.col(c), F.lit(False))
    return df.withColumns({f"_k_{c}": F.col(f"_k_{c}") * 2 + (at(c, 0) & at(c, 1)).cast("int") for c in cols})


def _ranked_by_value(df: DataFrame, by: list[str], c: str, weight: str | None) -> DataFrame:
    """For a column of few values: each is ranked by the counts of all, and the ranks are looked up. What is collected and broadcast is a row for each group and value."""
    counts = df.groupBy(*by, c).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_w"))
    ranks = counts.filter(F.col(c).isNotNull()).select(*by, c, percent_rank_average(F.col(c), by, "_w").alias("_p"))
    names = [f"_b{i}" for i in range(len(by))] + ["_value", "_p"]
    table = df.sparkSession.createDataFrame(ranks.collect(), T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, ranks.schema, strict=True)]))
    same = [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)] + [F.col(c) == F.col("_value")]
    return df.join(F.broadcast(table), on=same, how="left").withColumn(c, F.coalesce("_p", F.lit(0.5))).select(*df.columns)


def percent_ranks(df: DataFrame, by: list[str], cols: list[str], weight: str | None = None) -> DataFrame:
    """The columns' values replaced by percent_rank_average within the groups, whatever the groups' sizes.

    Columns of few values (CUT_ROWS / 5 of all groups, about) are ranked by their counts. The others:

    Large groups are cut at approximate quantiles. Exact counts of what lies between the cuts give
    each bucket its first rank, so that only buckets are sorted; a value that fills buckets of its own is
    ranked by its count and not moved. Cuts and counts are collected, rows / CUT_ROWS of each column at most
    and twice as many.
    """
    spark = df.sparkSession
    few = [c for c, (n, _) in zip(cols, _differing(df, [[*by, c] for c in cols]), strict=True) if n <= CUT_ROWS // 5]
    for c in few:
        df = _ranked_by_value(df, by, c, weight)
    cols = [c for c in cols if c not in few]
    found = _cuts(df, by, cols) if cols else []
    if not found:
        return df.withColumns({c: percent_rank_average(F.col(c), by, weight) for c in cols})
    kinds = {f.name: f.dataType for f in df.schema}
    keys = [T.StructField(f"_b{i}", kinds[b]) for i, b in enumerate(by)]
    cuts = [T.StructField(f"_cuts_{c}", T.ArrayType(kinds[c])) for c in cols]
    table = spark.createDataFrame([tuple(r) for r in found], T.StructType(keys + cuts))

    # a pass for each column: in one, the code of all grows beyond what the JVM compiles; rows of groups without cuts are counted together
    counts: dict = {}
    for i, c in enumerate(cols):
        part = table.select(*[k.name for k in keys], f"_cuts_{c}", F.lit(True).alias("_cut"))
        coded = _with_codes(_with_table(df.filter(F.col(c).isNotNull()), part, by), [c])
        kept = [F.when(F.col("_cut"), F.col(b)).alias(k.name) for b, k in zip(by, keys, strict=True)]
        for *key, cut, k, n in coded.groupBy(*kept, "_cut", f"_k_{c}").agg(_number(F.col(c), weight)).collect():
            counts.setdefault((tuple(key) if cut else None, i), {})[k] = n
    uncut = {i for key, i in counts if key is None}
    loose = {i for (key, i), x in counts.items() if key is None or any(k % 2 == 0 for k in x)}

    rows, n_by = [], len(by)
    for r in found:
        row = list(r)
        for i in range(len(cols)):
            sizes = counts.get((tuple(r[:n_by]), i), {})
            dense = [sizes.get(k, 0) for k in range(2 * len(r[n_by + i]) + 2)]
            row += [dense, [0, *accumulate(dense[:-1])], sum(dense)]
        rows.append(tuple(row))
    long = T.LongType()
    facts = [T.StructField(f"_{n}_{c}", t) for c in cols for n, t in (("sizes", T.ArrayType(long)), ("firsts", T.ArrayType(long)), ("all", long))]
    table = spark.createDataFrame(rows, T.StructType(keys + cuts + facts))
    for i in sorted(range(len(cols)), key=lambda i: i in loose):
        df = _ranked_column(df, table, by, cols[i], i in loose, i in uncut, weight)
    return df


def _ranked_column(df: DataFrame, table: DataFrame, by: list[str], c: str, loose: bool, uncut: bool, weight: str | None) -> DataFrame:
    """loose: not all values are ranked by their counts; uncut: some groups have no cuts."""
    names, value, code = df.columns, F.col(c), F.col(f"_k_{c}")
    part = table.select(*[f"_b{i}" for i in range(len(by))], *[f"_{n}_{c}" for n in ("cuts", "sizes", "firsts", "all")])
    df = _with_codes(_with_table(df, part, by), [c]).withColumn("_first", F.get(f"_firsts_{c}", code)).withColumn("_n", F.col(f"_all_{c}"))
    share = F.when(F.col("_n") <= 1, F.lit(0.5)).otherwise((F.col("_first") + 1 + (F.get(f"_sizes_{c}", code) - 1) / 2 - 1) / (F.col("_n") - 1))
    df = df.withColumn("_p", F.when(value.isNull(), F.lit(0.5)).when(code % 2 == 1, share))
    if loose:
        # what has its rank already goes anywhere
        df = df.withColumn("_g", F.when(F.col("_p").isNotNull(), -1 - F.pmod(F.hash(*names), F.lit(1024))).otherwise(F.coalesce(code, F.lit(0)))).select(*names, "_g", "_p", "_first", "_n")
        bucket = [*by, "_g"]
        n = F.coalesce("_n", _number(value, weight).over(Window.partitionBy(*bucket))) if uncut else F.col("_n")
        df = df.withColumns({"_r": _rank(value, bucket, weight), "_t": _number(value, weight).over(Window.partitionBy(*bucket, value)), "_n": n})
        rank = F.coalesce("_first", F.lit(0)) + F.col("_r") + (F.col("_t") - 1) / 2
        df = df.withColumn("_p", F.coalesce("_p", F.when(F.col("_n") <= 1, F.lit(0.5)).otherwise((rank - 1) / (F.col("_n") - 1))))
    # a lambda ends the generated method: with the searches of three columns in one, it grows beyond what the JVM compiles
    out = F.col("_p") if loose else F.get(F.transform(F.array("_p"), lambda x: x), F.lit(0))
    return df.withColumn(c, out).select(*names)


def _mean(cols: list[str]) -> Column:
    return sum((F.col(c) for c in cols), F.lit(0.0)) / F.lit(len(cols))


def composite_score(df: DataFrame, by: list[str], parts: list[Column], name: str = "score") -> DataFrame:
    """Mean of the percentile ranks of the parts within the groups."""
    cols = [f"_p{i}" for i in range(len(parts))]
    df = percent_ranks(df.withColumns(dict(zip(cols, parts, strict=True))), by, cols)
    return df.withColumn(name, _mean(cols)).drop(*cols)


#: Rows that are ranked as one need so many equal ones each, for the shuffle that brings them together; groups are sorted whole if there are fewer rows in all than so many cuts stand for.
EQUAL_ROWS, WHOLE_CUTS = 8, 20


def composite_counts(df: DataFrame, by: list[str], parts: list[Column], digits: int, name: str = "score", count: str = "n") -> DataFrame:
    """Rows by group and rounded composite score.

    Rows with the same parts have the same score: where there are many, they are brought together first, with their number as weight.
    """
    cols = [f"_p{i}" for i in range(len(parts))]
    df, weight = df.select(*by, *[p.alias(c) for p, c in zip(parts, cols, strict=True)]), None
    [(differing, equal)] = _differing(df, [[*by, *cols]])
    if equal >= EQUAL_ROWS:
        df, weight = df.groupBy(*by, *cols).agg(F.count(F.lit(1)).alias("_w")), "_w"
    # ranks are never null, which the planner does not see: it would shuffle once with a filter and once without
    score = F.coalesce(F.round(_mean(cols), digits), F.lit(0.5)).alias(name)
    n = (F.sum(weight) if weight else F.count(F.lit(1))).alias(count)
    if differing * (1 if weight else equal) <= WHOLE_CUTS * CUT_ROWS:
        ranks = df.withColumns({c: percent_rank_average(F.col(c), by, weight) for c in cols})
        # a shuffle that all readers share; the groups need none
        return ranks.select(*by, score, *[weight] * bool(weight)).repartition(*by, name).groupBy(*by, name).agg(n)
    return percent_ranks(df, by, cols, weight).groupBy(*by, score).agg(n)


#: Cells of a range in a search for a quantile, and how often the range is cut before what is left is sorted.
CELLS, LEVELS = 1 << 16, 2


def quantiles(df: DataFrame, x: str, qs: list[float], name: str = "_limits", weight: str | None = None) -> DataFrame:
    """One row: exact quantiles of the non-null values, interpolated between neighbours; with a weight, rows are counts already.

    Counts by value are summed up in cells of equal width between the least and the greatest value; the cell of
    each rank that is asked for is cut into cells again, and only the values of the last cell are sorted.
    """
    values, v = df.filter(F.col(x).isNotNull()), F.col(x).cast("double").alias("_v")
    counts = values.groupBy(v).agg(F.count(F.lit(1)).alias("_c")) if weight is None else values.select(v, F.col(weight).alias("_c"))
    place = F.array(*[F.struct(F.lit(2 * i + up).alias("_t"), (F.ceil if up else F.floor)((F.col("_all") - 1) * F.lit(q)).alias("_r")) for i, q in enumerate(qs) for up in (0, 1)])
    ends = counts.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_all"))
    sought = ends.filter("_all > 0").select("_lo", "_hi", "_all", F.lit(0).cast("long").alias("_before"), F.explode(place).alias("_x")).select("_lo", "_hi", "_all", "_before", "_x.*")
    far, endless = F.lit(1.7976931348623157e308), F.lit(float("inf"))
    lo, hi = (F.greatest(F.least(F.col(c), far), -far) / 2 for c in ("_lo", "_hi"))
    cell = F.when(F.col("_v") == -endless, F.lit(-1)).when(F.col("_v") >= endless, F.lit(CELLS + 1)).when(hi <= lo, F.lit(0)).otherwise(F.floor((F.col("_v") / 2 - lo) / (hi - lo) * CELLS))
    for level in range(LEVELS + 1):
        within = counts.join(F.broadcast(sought), (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        cells = within.groupBy("_t", "_r", "_all", "_before", (cell if level < LEVELS else F.col("_v")).alias("_cell")).agg(F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.col("_before") + F.sum("_c").over(Window.partitionBy("_t").orderBy("_cell"))
        sought = cells.withColumn("_upto", upto).filter((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_c"))).select("_lo", "_hi", "_all", (F.col("_upto") - F.col("_c")).alias("_before"), "_t", "_r")
    ends = sought.agg(F.max("_all").alias("_all"), *[F.max(F.when(F.col("_t") == t, F.col("_lo"))).alias(f"_v{t}") for t in range(2 * len(qs))])
    share = lambda q: (F.col("_all") - 1) * F.lit(q) - F.floor((F.col("_all") - 1) * F.lit(q))
    between = [F.when(F.col(a) == F.col(b), F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * share(q)) for q, a, b in ((q, f"_v{2 * i}", f"_v{2 * i + 1}") for i, q in enumerate(qs))]
    return ends.select(F.array(*between).alias(name))


def tiers(df: DataFrame, score: str = "score", cuts: tuple[tuple[str, float], ...] = (("high", 0.98), ("medium", 0.90)), rest: str = "low", weight: str | None = None) -> DataFrame:
    """+ tier: the first cut whose pooled quantile the score is strictly above. The quantiles are one row, broadcast. weight: how many rows a row stands for."""
    limits = quantiles(df, score, [q for _, q in cuts], weight=weight)
    tier = F.lit(rest)
    for i in reversed(range(len(cuts))):
        tier = F.when(F.col(score) > F.col("_limits")[i], F.lit(cuts[i][0])).otherwise(tier)
    return df.crossJoin(F.broadcast(limits)).withColumn("tier", tier).drop("_limits")

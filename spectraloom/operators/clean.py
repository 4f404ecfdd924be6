"""Predicates with stated null policies, sentinels, schema alignment and casts that count their losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequences import has_glyco_code


def nullable_filter(col: Column, op: str, limit: float) -> Column:
    """col IS NULL or col <op> limit; op is <= or >=."""
    if op not in ("<=", ">="):
        raise ValueError(f"unsupported operator {op!r}")
    return col.isNull() | (col <= limit if op == "<=" else col >= limit)


def quality_labelled(rt: Column, offset: Column, charge: Column, mz: Column, seq: Column) -> Column:
    """Nulls pass; a sequence with an unresolved code does not."""
    numeric = [nullable_filter(rt, "<=", 10800), nullable_filter(offset, "<=", 300), nullable_filter(charge, ">=", 0), nullable_filter(charge, "<=", 7), nullable_filter(mz, "<=", 2000)]
    out = ~has_glyco_code(seq)
    for n in numeric:
        out = n & out
    return out


def quality_unlabelled(rt: Column, offset: Column, charge: Column, mz: Column) -> Column:
    """The same bounds, but nulls are dropped."""
    return (rt <= 10800) & (offset <= 300) & charge.between(0, 7) & (mz <= 2000)


def in_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is among the values; without the column all rows."""
    return df.filter(F.col(column).isin(values)) if column in df.columns else df


def conditional(df: DataFrame, allowed: dict[str, list]) -> DataFrame:
    """AND over columns of value in allowed, as strings."""
    for column, values in allowed.items():
        if column not in df.columns:
            raise ValueError(f"no column {column}")
        df = df.filter(F.col(column).cast("string").isin([str(v) for v in values]))
    return df


def blank_to_null(col: Column) -> Column:
    return F.when(F.trim(col).isin("", "None", "nan", "NaN"), F.lit(None)).otherwise(col)


def sentinel_to_null(df: DataFrame, columns: list[str], sentinel: str = "Unknown") -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in columns if c in df.columns})


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames where the source exists and the target does not."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns})


def align(df: DataFrame, schema: T.StructType, names: dict[str, str] | None = None, cast: bool = False) -> DataFrame:
    """Exactly the columns of the schema, in order: missing ones as typed nulls, others dropped; leniently cast on request."""
    df = rename(df, names or {})
    one = lambda f: (F.col(f.name).try_cast(f.dataType) if cast else F.col(f.name)) if f.name in df.columns else F.lit(None).cast(f.dataType)
    return df.select(*[one(f).alias(f.name) for f in schema.fields])


def cast_losses(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Per column: values that a lenient cast makes null, and values that it moves."""
    aggs = []
    for c, t in types.items():
        x, y = F.col(c), F.col(c).try_cast(t)
        aggs.append(F.struct(F.lit(c).alias("column"), F.count_if(x.isNotNull() & y.isNull()).alias("lost"), F.count_if(y.isNotNull() & (y.try_cast("double") != x.try_cast("double"))).alias("moved")).alias(c))
    return df.agg(*aggs).select(F.explode(F.array(*[F.col(c) for c in types])).alias("_s")).select("_s.*")


def first_failing(checks: list[tuple[str, Column]], otherwise: str = "eligible") -> Column:
    """Name of the first check that holds."""
    out = F.lit(otherwise)
    for name, bad in reversed(checks):
        out = F.when(bad, F.lit(name)).otherwise(out)
    return out


def find_column(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate that is a column, whatever the case."""
    known = {c.lower(): c for c in columns}
    return next((known[c.lower()] for c in candidates if c.lower() in known), None)

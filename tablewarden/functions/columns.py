"""Small Column helpers used by every operator."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    return F.col("`" + str(name).replace("`", "``") + "`")


def lit_list(values: Sequence[Any]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lit_map(mapping: dict[str, Any]) -> Column:
    pairs: list[Column] = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)


def null_if_nan(df: DataFrame) -> DataFrame:
    """NaN counts as null: map it once on ingest for float columns."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[
        F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns
    ])


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form ``(keep…, column, value)`` with every value as text; one narrow pass, no shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns])
    return df.select(*[col(k) for k in keep], F.inline(pairs))


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(default).cast("double"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row instead of once per mention."""
    return F.element_at(F.transform(F.array(value), body), 1)


def computed_once(df: DataFrame, **named: Column) -> DataFrame:
    """Add columns behind a one-element generator, so that the optimizer does not copy a costly expression into
    every later place (or into a pushed-down filter) that mentions it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in named.items()]))))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on key columns whose nulls match each other (a null partition value is a partition too)."""
    if not keys:
        return left.crossJoin(right)      # both sides are one row then
    renamed = right.select(*[col(k).alias(f"_j_{i}") for i, k in enumerate(keys)], *[col(c) for c in right.columns if c not in keys])
    on = [col(k).eqNullSafe(F.col(f"_j_{i}")) for i, k in enumerate(keys)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(renamed, cond, how).drop(*[f"_j_{i}" for i in range(len(keys))])


PARTITIONS = "spark.tablewarden.partitions"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows over as many tasks as the session setting ``spark.tablewarden.partitions`` says before a costly per-row stage.

    Unset (the default) the input's own splits are used, whatever the size: set it where few large files feed many cores.
    """
    n = df.sparkSession.conf.get(PARTITIONS, None)
    return df.repartition(int(n), *[col(k) for k in keys]) if n else df


def dealt(df: DataFrame) -> DataFrame:
    """Deal narrow rows over all cores before expressions that take about a millisecond a row: a small file is one split, whatever it costs."""
    spark = df.sparkSession
    n = spark.conf.get(PARTITIONS, None) or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(int(n))


def chunked(items: Sequence[Any], size: int) -> list[list[Any]]:
    return [list(items[i:i + size]) for i in range(0, len(items), size)]


def one_row(df: DataFrame, aggs: Sequence[Column], size: int = 150) -> DataFrame:
    """One aggregate row for any number of aggregates.

    Whole-stage code generation gives up on very wide aggregates, so they run in chunks over the
    same pruned scan and the one-row results are put side by side.
    """
    parts = [df.agg(*chunk) for chunk in chunked(list(aggs), size)]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out

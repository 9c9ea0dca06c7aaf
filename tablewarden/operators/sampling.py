"""Sampling of tables: partition, percent, column-first, fixed size, values per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tablewarden.functions.columns import col, scalar_columns, string_columns
from tablewarden.operators.profile import PII_NAME_HINTS


def partition(df: DataFrame, column: str, value: str | None = None) -> DataFrame:
    """One partition: the given one, else the newest (one aggregate over the partition column)."""
    if value is not None:
        return df.where(col(column).cast("string") == value)
    newest = df.agg(F.max(col(column)).alias("_newest"))
    return df.join(F.broadcast(newest), col(column) == F.col("_newest"), "left_semi")      # one row


def table_partition(spark: SparkSession, table: str, column: str, value: str | None = None) -> DataFrame:
    """The same for a catalogue table, from its partition list instead of its data where it has one."""
    df = spark.table(table)
    if value is None:
        try:
            names = [r[0] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]       # partition names only
            value = max(n.split(f"{column}=")[1].split("/")[0] for n in names if f"{column}=" in n)
        except Exception:  # noqa: BLE001 - not a partitioned table
            return partition(df, column)
    return partition(df, column, value)


def fraction(df: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """Repeatable Bernoulli sample."""
    return df.sample(withReplacement=False, fraction=share, seed=seed)


def column_first(df: DataFrame, share: float, hints: Sequence[str] = PII_NAME_HINTS, seed: int = 42) -> DataFrame:
    """Only text columns whose name carries a hint (all text columns when none does), then a sample."""
    texts = string_columns(df)
    named = [c for c in texts if any(h in c.lower() for h in hints)]
    return fraction(df.select(*[col(c) for c in (named or texts)]), share, seed)


def fixed_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """About n rows: the matching fraction, then a limit."""
    total = df.count()
    return df if total <= n else df.sample(False, min(1.0, n / total), seed).limit(n)


def stratified(df: DataFrame, column: str, shares: dict, seed: int = 42) -> DataFrame:
    return df.sampleBy(column, shares, seed)


def as_strings(df: DataFrame, string_only: bool = False) -> DataFrame:
    names = string_columns(df) if string_only else df.columns
    return df.select(*[col(c).cast("string").alias(c) for c in names])


def _smallest(n: int, columns: int):
    """The n different values of least hash per column among a task's rows (value, hash for each column)."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        held: list[dict] = [{} for _ in range(columns)]              # (hash, value) → None
        border = [np.iinfo(np.int64).max] * columns
        for batch in batches:
            for i in range(columns):
                value, code = batch.column(2 * i), batch.column(2 * i + 1)
                codes = code.fill_null(0).to_numpy(zero_copy_only=False)
                at = np.flatnonzero((codes <= border[i]) & value.is_valid().to_numpy(zero_copy_only=False))
                if not len(at):
                    continue
                least = np.unique(codes[at])[:n]
                at = at[codes[at] <= least[-1]]
                order = at[np.argsort(codes[at], kind="stable")]
                found, last = held[i], None
                for j in order.tolist():                               # equal neighbours are read once
                    pair = (int(codes[j]), value[j].as_py())
                    if pair != last:
                        found[pair] = None
                        last = pair
                if len(found) >= n:
                    held[i] = dict.fromkeys(sorted(found)[:n])
                    border[i] = max(held[i])[0]
        rows = [(i, v, h) for i, found in enumerate(held) for h, v in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["i", "value", "h"])

    return run


def values(df: DataFrame, n: int = 100, seed: int = 42, columns: Sequence[str] | None = None) -> DataFrame:
    """n values per column in keyed hash order: the same values for the same seed on any cluster.

    One pass: a task keeps the n values of least hash that it has met per column, and only these meet others.
    """
    names = list(columns or scalar_columns(df))
    cells = []
    for i, c in enumerate(names):
        text = col(c).cast("string")
        cells += [text.alias(f"v{i}"), F.xxhash64(text, F.lit(seed)).alias(f"h{i}")]
    kept = df.select(*cells).mapInArrow(_smallest(n, len(names)), "i int, value string, h bigint").distinct()
    w = W.partitionBy("i").orderBy("h", "value")
    named = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("i") + 1)
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(named.alias("column"), "value", "rank")

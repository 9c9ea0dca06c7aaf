"""Shards of near-equal bytes by sampled splitters.

Keys are drawn with a chance in proportion to their record's size; quantiles of the draw are the borders of key ranges of
about equal bytes.  The ranges are then weighed exactly, and an overfull one (one hot key, or a poor draw) is subdivided by a
hash.  The exact sums of all ranges before it and the running sum inside a range give every record its place in one line of
bytes; the line is cut into equal shards, so no two shards differ by more than the two largest records.

Only keys and sizes need move: join texts by key, or call with a frame that carries them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

RANGES_A_SHARD = 8            # key ranges for each shard, at least
DRAWS_A_RANGE = 16            # sampled keys for each range
RANGE_ROWS = 1_000_000        # more rows in a range than this on average, and there are more ranges


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds lie at or below the key; by hundreds first, then inside the hundred."""
    if not bounds:
        return F.lit(0)
    step = 100
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    count = lambda values: F.size(F.filter(F.lit(values).cast("array<bigint>"), lambda b: b <= key))
    if len(groups) == 1:
        return count(bounds)
    group = F.greatest(count([g[0] for g in groups]) - 1, F.lit(0))
    inside = F.get(F.array(*[F.lit(g).cast("array<bigint>") for g in groups]), group)
    return group * step + F.size(F.filter(inside, lambda b: b <= key))


def assign(df: DataFrame, n: int, key: str = "doc_id", size: str = "size") -> DataFrame:
    """``df`` with ``shard`` (0 to n-1) and ``slot`` (0, 1, ... inside the shard), both replaced where they exist.

    Ordered by integer key (null keys first), then by the other columns' hash; null sizes count as 0.  Rows with equal keys are told
    apart by that hash, so a hot key is subdivided like any overfull range.  Repeated rows each get a slot of their own.  An
    empty frame gives an empty one.
    """
    rest = [c for c in df.columns if c not in ("shard", "slot")]
    rows = df.select(*rest).withColumn("_key", F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(-(1 << 63)))) \
        .withColumn("_size", F.greatest(F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)), F.lit(0))) \
        .withColumn("_hash", F.xxhash64(*[F.col(f"`{c}`") for c in rest]))
    total, count = df.select(*rest).select(F.greatest(F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)), F.lit(0)).alias("s")).agg(F.sum("s"), F.count(F.lit(1))).first()
    total = total or 0
    ranges = max(RANGES_A_SHARD * n, count // RANGE_ROWS)
    draws = ranges * DRAWS_A_RANGE
    chance = F.col("_size") * F.lit(float(draws)) / F.lit(float(max(total, 1)))
    drawn = rows.where(F.pmod("_hash", F.lit(1 << 30)) / F.lit(float(1 << 30)) < chance).select("_key")
    keys = sorted(r[0] for r in drawn.collect())                    # about ``draws`` keys whatever the input
    bounds = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []
    ranged = rows.withColumn("_range", _range_of(F.col("_key"), bounds))
    # overfull ranges: at most ``ranges`` rows come to the driver
    weights = ranged.groupBy("_range").agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    fair, fair_rows = max(total / ranges, 1), max(2 * count / ranges, RANGE_ROWS)
    parts = [1] * (len(bounds) + 1)
    for w in weights:
        if w["bytes"] > 4 * fair or w["rows"] > fair_rows:
            parts[w["_range"]] = max(1, round(max(w["bytes"] / fair, w["rows"] / fair_rows)))
    part = F.pmod(F.shiftright("_hash", 30), F.get(F.lit(parts).cast("array<int>"), F.col("_range")))
    ranged = ranged.withColumn("_part", part.cast("int"))
    inside = W.partitionBy("_range", "_part").orderBy("_key", "_hash")
    before = W.orderBy("_range", "_part").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy("_range", "_part").agg(F.sum("_size").alias("b"), F.count(F.lit(1)).alias("r")).select(
        "_range", "_part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_bytes"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("_rows"))
    placed = (
        ranged.withColumn("_run", F.coalesce(F.sum("_size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_nth", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["_range", "_part"])                # one row a range part
        .withColumn("_place", F.col("_rows") + F.col("_nth"))
        .withColumn("shard", F.least(F.floor((F.col("_bytes") + F.col("_run")).cast("decimal(38,0)") * n / F.lit(max(total, 1))), F.lit(n - 1)).cast("int"))
    )
    first = placed.groupBy("shard").agg(F.min("_place").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(*[F.col(f"`{c}`") for c in rest], "shard", (F.col("_place") - F.col("_first")).alias("slot"))

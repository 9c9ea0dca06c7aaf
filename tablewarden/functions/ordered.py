"""Exact global order over tables of any size.

A window without PARTITION BY, or ``percentile`` without a bound on the number of values, puts a whole
column into one task.  Here a quantile sketch bounds the wanted quantiles, and only values inside these bounds are
ordered; neighbours and ranks come from sorted range partitions, of which one small row each carries across the
borders.  Rows of one value may lie in several partitions, so a value that holds a third of all rows is no large task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F, types as T

from tablewarden.functions.columns import col, join_null_safe


#: Sketch bounds lie this many of its guaranteed errors beside the wanted quantile.
MARGIN, ACCURACY = 4, 10_000


def _positions(total: Column, p: float, method: str) -> Column:
    """0-based position of a quantile in the sorted values, with a fraction where it lies between two."""
    if method == "linear":
        return (total - 1) * F.lit(float(p))
    return F.greatest(F.ceil(total * F.lit(float(p))) - 1, F.lit(0)).cast("double")


def _bands(rows: DataFrame, groups: Sequence[str], probs: Sequence[float], accuracy: int) -> DataFrame:
    """One row per group: ``_bands``, an array of (lo, hi) that hold the wanted quantiles, ascending."""
    slack = MARGIN / accuracy
    least, most = F.min("_d"), F.max("_d")
    lows, highs = [p - slack for p in probs], [p + slack for p in probs]
    inner = sorted({p for p in lows + highs if 0 < p < 1})
    sketch = F.percentile_approx("_d", F.array(*[F.lit(p) for p in inner]), F.lit(accuracy)) if inner else F.array().cast("array<double>")
    found = rows.groupBy(*groups).agg(sketch.alias("_s"), least.alias("_min"), most.alias("_max"), F.count(F.lit(1)).alias("_n"))
    few = F.col("_n") <= 2 * accuracy                                            # where a rank or two would count, all values are kept
    at = lambda p, end: end if not 0 < p < 1 else F.when(few, end).otherwise(F.col("_s")[inner.index(p)])
    at_lo, at_hi = (lambda p: at(p, F.col("_min"))), (lambda p: at(p, F.col("_max")))
    step = lambda x: F.when(F.abs(x) < F.lit(float("inf")), F.abs(x) * F.lit(2.0 ** -50)).otherwise(F.lit(0.0))
    each = F.array(*[F.struct((at_lo(lo) - step(at_lo(lo))).alias("lo"), (at_hi(hi) + step(at_hi(hi))).alias("hi")) for lo, hi in zip(lows, highs)])
    return found.select(*groups, each.alias("_bands"))


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float], method: str | Sequence[str] = "linear", accuracy: int = ACCURACY,
                    few_groups: bool = False) -> DataFrame:
    """One row per group with ``quantiles``: array<double> in the order of ``probs``, and ``n``.

    ``linear`` interpolates between neighbours; ``nearest`` takes the smallest value whose share of the rows reaches the probability; a list names one
    method for each probability.  The first pass makes a mergeable sketch per group, whose error bound gives a band around each quantile.  The second pass
    counts the rows between the bands and the different values inside them (``2 * MARGIN / accuracy`` of the rows for a quantile); only these are
    ordered.  Nothing is written and no job runs before the result is read.  ``few_groups`` promises that the groups fit into a broadcast.
    """
    methods = [method] * len(probs) if isinstance(method, str) else list(method)
    d = col(value).cast("double")
    rows = df.where(col(value).isNotNull()).select(*[col(g) for g in groups], col(value).alias("_x"), F.when(F.isnan(d), F.lit(float("inf"))).otherwise(d).alias("_d"))
    bands = _bands(rows, groups, sorted(set(probs)), accuracy)
    joined = join_null_safe(rows, F.broadcast(bands) if few_groups or not groups else bands, groups)
    inside = F.exists("_bands", lambda b: (F.col("_d") >= b["lo"]) & (F.col("_d") <= b["hi"]))
    above = F.size(F.filter("_bands", lambda b: b["lo"] > F.col("_d")))          # a row is below another one in a band if more bands are above it
    cells = joined.groupBy(*groups, above.alias("_above"), F.when(inside, F.col("_x")).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    per_group = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    before = F.sum("_n").over(per_group.orderBy(F.desc("_above"), F.asc_nulls_last("_x")).rowsBetween(W.unboundedPreceding, -1))
    placed = cells.select(*groups, "_x", "_n", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(per_group).alias("_total"))

    aggs, total = {}, F.col("_total")
    for i, (p, m) in enumerate(zip(probs, methods)):
        for name, side in (("lo", F.floor), ("hi", F.ceil)):
            rank = side(_positions(total, p, m))
            aggs[f"_{name}{i}"] = F.max(F.when((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_n")), F.col("_x").cast("double")))
    per = placed.groupBy(*groups).agg(F.max("_total").alias("_total"), *[c.alias(n) for n, c in aggs.items()])

    def pick(i: int) -> Column:
        k, lo, hi = _positions(total, probs[i], methods[i]), F.col(f"_lo{i}"), F.col(f"_hi{i}")
        missed = total.isNotNull() & (lo.isNull() | hi.isNull())
        between = F.when(F.floor(k) == F.ceil(k), lo).otherwise(lo + (hi - lo) * (k - F.floor(k)))
        return F.when(missed, F.raise_error(F.lit("a quantile lies outside the bounds of its sketch")).cast("double")).otherwise(between)

    return per.select(*groups, F.array(*[pick(i) for i in range(len(probs))]).alias("quantiles"), total.alias("n"))


def _sorted_ranges(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in ascending ``keys`` over the partitions and inside them; equal rows may be split among partitions."""
    return rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*[col(k) for k in keys], F.col("_tie")).drop("_tie").sortWithinPartitions(*[col(k) for k in keys])


def _summaries(n_groups: int, schema_names: Sequence[str]):
    """Of each run of rows of one group in a sorted partition: its first and last value, rows, and steps up, down and level."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def differs(a, b):
        return pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        task, seq, held = TaskContext.get().partitionId(), 0, None

        def rows(runs):
            columns = [[r[0][k] for r in runs] for k in range(n_groups)] + [[r[k] for r in runs] for k in range(1, 7)]
            return pa.RecordBatch.from_arrays([*(pa.array(c, type=t) for c, t in zip(columns[:n_groups], kinds)), pa.array([task] * len(runs), type=pa.int32()), pa.array([r[7] for r in runs], type=pa.int64()),
                                               *(pa.array(c, type=kinds[-1]) for c in columns[n_groups:n_groups + 2]), *(pa.array(c, type=pa.int64()) for c in columns[n_groups + 2:])], names=list(schema_names))

        for batch in batches:
            if not len(batch):
                continue
            kinds = batch.schema.types
            values = batch.column(n_groups)
            if pa.types.is_floating(values.type):
                values = pc.if_else(pc.is_nan(values), float("inf"), values)
            prev, cur = values.slice(0, len(values) - 1), values.slice(1)
            fresh = np.zeros(len(values), dtype=bool)
            fresh[0] = True
            for k in range(n_groups):
                g = batch.column(k)
                fresh[1:] |= differs(g.slice(0, len(g) - 1), g.slice(1)).to_numpy(zero_copy_only=False)
            steps = [np.concatenate([[False], f(prev, cur).to_numpy(zero_copy_only=False)]) & ~fresh for f in (pc.less, pc.greater, pc.equal)]
            starts = np.flatnonzero(fresh)
            ends = np.append(starts[1:], len(values))
            sums = [np.add.reduceat(x.astype(np.int64), starts) for x in steps]
            done = []
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                group = [batch.column(k)[a].as_py() for k in range(n_groups)]
                new = [group, values[a].as_py(), values[b - 1].as_py(), b - a, *(int(x[i]) for x in sums), seq]
                if held is not None and held[0] == group:
                    held[4] += new[4] + (held[2] < new[1])
                    held[5] += new[5] + (held[2] > new[1])
                    held[6] += new[6] + (held[2] == new[1])
                    held[2], held[3] = new[2], held[3] + new[3]
                else:
                    done += [held] if held is not None else []
                    held, seq = new, seq + 1
            if done:
                yield rows(done)
        if held is not None:
            yield rows([held])

    return run


def order_steps(df: DataFrame, groups: Sequence[str], order: str, value: str) -> DataFrame:
    """Steps between neighbours in the order of ``order`` (ties: of ``value``) per group: n (rows with a value), ups, downs and sames.

    One range shuffle; every sorted range is folded into a small row of first and last value and counts, and these are folded in order.
    """
    kind = df.schema[value].dataType
    x = col(value).cast("int") if isinstance(kind, T.BooleanType) else col(value)
    rows = df.where(col(value).isNotNull()).select(*[col(g).alias(f"_g{i}") for i, g in enumerate(groups)], col(order).alias("_o"), x.alias("_v"))
    names = [f"_g{i}" for i in range(len(groups))]
    dealt = _sorted_ranges(rows, [*names, "_o", "_v"]).select(*names, "_v")
    kinds = {f.name: f.dataType for f in dealt.schema.fields}
    out = [*names, "_task", "_seq", "_first", "_last", "_rows", "_ups", "_downs", "_sames"]
    types = [*(kinds[n] for n in names), T.IntegerType(), T.LongType(), kinds["_v"], kinds["_v"], *[T.LongType()] * 4]
    runs = dealt.mapInArrow(_summaries(len(names), out), T.StructType([T.StructField(n, t) for n, t in zip(out, types)]))
    before = F.lag("_last").over((W.partitionBy(*names) if names else W.partitionBy(F.lit(0))).orderBy("_task", "_seq"))
    edges = runs.withColumn("_before", before)

    def total(steps: str, here: Column) -> Column:
        return F.sum(F.col(steps) + F.coalesce(here, F.lit(False)).cast("bigint"))

    b, f = F.col("_before"), F.col("_first")
    found = edges.groupBy(*names).agg(F.sum("_rows").alias("n"), total("_ups", b < f).alias("ups"), total("_downs", b > f).alias("downs"), total("_sames", b == f).alias("sames"))
    return found.select(*[F.col(n).alias(g) for n, g in zip(names, groups)], "n", "ups", "downs", "sames")


def _runs_of(batches):
    """A sorted partition of (k, x, row) as numpy arrays, and of each row: its run, and of the runs: column, first place in the column, rows, value."""
    import numpy as np

    held = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for b in batches if len(b)]
    if not held:
        return None
    k, x, row = (np.concatenate([h[i] for h in held]) for i in range(3))
    fresh = np.ones(len(k), dtype=bool)
    fresh[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1])
    first = np.flatnonzero(fresh)
    columns = np.flatnonzero(np.diff(k[first], prepend=-1))                    # the first run of every column
    start = first - np.repeat(first[columns], np.diff(np.append(columns, len(first))))
    return row, np.cumsum(fresh) - 1, k[first], start, np.diff(np.append(first, len(k))), x[first]


def _local_ranks(batches):
    """(row, k, task, place, edge): place is the average place of the row's run among the column's rows of this task, edge whether the run touches a border (1 first, 2 last)."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    runs = _runs_of(batches)
    if runs is None:
        return
    row, run, k, start, n, _ = runs
    edge = np.zeros(len(k), dtype=np.int32)
    edge[np.diff(k, append=-1) != 0] = 2
    edge[np.diff(k, prepend=-1) != 0] = 1
    task = TaskContext.get().partitionId()
    for lo in range(0, len(row), 200_000):
        at = run[lo:lo + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(row[lo:lo + 200_000]), pa.array(k[at]), pa.array(np.full(len(at), task, dtype=np.int32)), pa.array(start[at] + (n[at] + 1) / 2), pa.array(edge[at])],
                                         names=["row", "k", "task", "place", "edge"])


def _edge_runs(batches):
    """(k, task, edge, start, n, value, rows): the runs that touch a border of the task, with the rows of the column in the task."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    runs = _runs_of(batches)
    if runs is None:
        return
    _, _, k, start, n, x = runs
    heads, tails = np.flatnonzero(np.diff(k, prepend=-1) != 0), np.flatnonzero(np.diff(k, append=-1) != 0)
    rows = start[tails] + n[tails]
    at = np.concatenate([heads, tails[tails != heads]])
    total = np.concatenate([rows, rows[tails != heads]])
    edge = np.concatenate([np.full(len(heads), 1), np.full(len(at) - len(heads), 2)]).astype(np.int32)
    task = np.full(len(at), TaskContext.get().partitionId(), dtype=np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(k[at]), pa.array(task), pa.array(edge), pa.array(start[at]), pa.array(n[at]), pa.array(x[at]), pa.array(total)],
                                     names=["k", "task", "edge", "start", "n", "value", "rows"])


ENTRIES_IN_TASK = 500_000


def ranked_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table's rows with every number replaced by its average 1-based rank in its column; nulls stay.

    One ranking of all columns: (column, value, row) is range-partitioned once, a task gives each row its place in the task, one small row for each task and
    column carries counts and border values across, and one grouping by row puts the ranks side by side.  Memory of a task: its own partition as numbers, ``ENTRIES_IN_TASK`` about.
    """
    entries = F.array(*[F.struct(F.lit(i).alias("k"), (col(c).cast("double") + F.lit(0.0)).alias("x")) for i, c in enumerate(columns)])
    numbered = df.select(*[col(c) for c in columns], F.monotonically_increasing_id().alias("_row"))      # before the rows are unpivoted
    # as many tasks as the entries ask for, so that a task's memory does not grow with the table
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() * len(columns) // ENTRIES_IN_TASK))
    long = numbered.select(F.col("_row").alias("row"), F.inline(entries)).where("x is not null").select("k", F.when(F.isnan("x"), F.lit(float("inf"))).otherwise(F.col("x")).alias("x"), "row")
    dealt = long.repartitionByRange(tasks, "k", "x", "row").sortWithinPartitions("k", "x")
    edges = dealt.mapInArrow(_edge_runs, "k int, task int, edge int, start bigint, n bigint, value double, rows bigint")
    earlier = W.partitionBy("k").orderBy("task").rangeBetween(W.unboundedPreceding, -1)
    spots = edges.withColumn("before", F.coalesce(F.sum(F.when(F.col("edge") == 1, F.col("rows"))).over(earlier), F.lit(0)))
    whole = W.partitionBy("k", "value")
    spots = spots.select("k", "task", "edge", "before", (F.min(F.col("before") + F.col("start")).over(whole) + (F.sum("n").over(whole) + 1) / 2).alias("rank"))
    borders = spots.groupBy("k", "task").agg(F.max("before").alias("before"), F.max(F.when(F.col("edge") == 1, F.col("rank"))).alias("head"), F.max(F.when(F.col("edge") == 2, F.col("rank"))).alias("tail"))
    places = dealt.mapInArrow(_local_ranks, "row bigint, k int, task int, place double, edge int")
    rank = F.when(F.col("edge") == 1, F.col("head")).when(F.col("edge") == 2, F.col("tail")).otherwise(F.col("before") + F.col("place"))
    # one row for each task and column
    ranks = places.join(F.broadcast(borders), ["k", "task"]).select("row", "k", rank.alias("rank"))
    return ranks.repartition(tasks, "row").groupBy("row").agg(*[F.max(F.when(F.col("k") == i, F.col("rank"))).alias(c) for i, c in enumerate(columns)]).drop("row")

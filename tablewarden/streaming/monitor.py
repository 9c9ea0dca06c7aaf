"""Rules, recording and masking on streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewarden.functions.columns import col
from tablewarden.operators import mask as M
from tablewarden.operators import results as R
from tablewarden.operators.rules import Rule, _result_struct, beside, compile_all, compile_rule, finished, key_counts, key_sums
from tablewarden.sources.stores import Store


#: Partitions of a micro-batch that are named in a filter; a batch that touches more of them is joined.
NAMED = 1_000


def _event_time(sdf: DataFrame, ts: str, watermark: str) -> DataFrame:
    """Event time as an instant, with a watermark on a stream."""
    if sdf.schema[ts].dataType.simpleString() == "timestamp_ntz":
        sdf = sdf.withColumn(ts, col(ts).cast("timestamp"))
    return sdf.withWatermark(ts, watermark) if sdf.isStreaming else sdf


def monitor(sdf: DataFrame, ts: str, rules: Sequence[Rule], window: str = "1 day", slide: str | None = None,
            watermark: str = "1 hour") -> DataFrame:
    """Rule results per event-time window; rows later than the watermark are dropped.

    Works the same on a static table.  Only rules that are plain aggregates can run here: exact distinct counts,
    quantiles and order need the whole window and belong to the batch run.
    """
    plans = [compile_rule(sdf, r) for r in rules]
    refused = [r.kind for r, p in zip(rules, plans) if p.side is not None or p.distinct or p.quantiles]
    if refused:
        raise ValueError(f"not available on a stream: {', '.join(refused)}")
    aggs = [c.alias(f"r{i}_{n}") for i, p in enumerate(plans) for n, c in p.aggs.items()]
    base = _event_time(sdf, ts, watermark)
    frame = F.window(col(ts), window, slide) if slide else F.window(col(ts), window)
    grouped = base.groupBy(frame.alias("w")).agg(F.count(F.lit(1)).alias("rows"), *aggs)
    rows = [_result_struct(r, p.finish(lambda n, i=i: F.col(f"r{i}_{n}"))) for i, (r, p) in enumerate(zip(rules, plans))]
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "rows", F.inline(F.array(*rows)))


def approximate_distinct(sdf: DataFrame, ts: str, columns: Sequence[str], window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Distinct values per window as a sketch of fixed size: what a stream can keep instead of a uniqueness rule."""
    base = _event_time(sdf, ts, watermark)
    return base.groupBy(F.window(col(ts), window).alias("w")).agg(*[F.approx_count_distinct(col(c)).alias(c) for c in columns])


def record(sdf: DataFrame, table: str, parts: Sequence[str], rules: Sequence[Rule], digest: str, store: Store, checkpoint: str,
           source: Callable[[SparkSession], DataFrame]) -> StreamingQuery:
    """Validate and store every partition that a micro-batch touches, as it stands in the table (``source`` reads it).

    A batch may hold a fragment of a partition, so the partition is validated whole: any rule works, the latest run always speaks of all rows, and
    the run key (which holds the data's fingerprint) makes a replayed batch a no-op.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        stamp = batch.sparkSession.sql("SELECT date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss.SSSSSS')").first()[0]
        touched = batch.select(*[col(p) for p in parts]).distinct()
        whole = source(batch.sparkSession)
        named = touched.limit(NAMED + 1).collect()
        if len(named) <= NAMED:      # values as literals prune the partitions that are read
            mine = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [col(p).eqNullSafe(F.lit(r[p])) for p in parts]) for r in named], F.lit(False))
            whole = whole.where(mine)
        else:
            same = reduce(lambda a, b: a & b, [whole[p].eqNullSafe(touched[p]) for p in parts])
            whole = whole.join(touched, same, "left_semi")
        store.validate(whole, table, parts, rules, digest, stamp)
    return sdf.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def record_increments(sdf: DataFrame, table: str, parts: Sequence[str], rules: Sequence[Rule], digest: str, store: Store, state: str, checkpoint: str) -> StreamingQuery:
    """As ``record``, but a micro-batch reads its own rows only: partial results of each batch are kept under ``state`` and added up.

    Rules must be additive (row rules, row counts) or on distinct values.  A batch leaves one row of counts and a sum of row hashes for each partition it
    touches, and one row for each (partition, key, digest) it holds; a run adds up the rows of all batches for the touched partitions.  So what is
    read grows with the batch and with the keys of its partitions, never with the source.  Results and fingerprints equal those of a batch run over
    the whole partitions.  A batch that runs again overwrites its own rows, and the run key makes its runs a no-op.
    """
    names = [col(p) for p in parts]

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        plans = compile_all(batch, rules)
        refused = [r.kind for r, p in zip(rules, plans) if not (p.distinct or p.additive or not (p.aggs or p.side or p.quantiles))]
        if refused:
            raise ValueError(f"does not add up over micro-batches: {', '.join(refused)}")
        keys = list(dict.fromkeys(p.distinct for p in plans if p.distinct))
        counts = [c.alias(f"r{i}_{n}") for i, p in enumerate(plans) for n, c in p.aggs.items()]
        row_hash = F.xxhash64(*[col(c) for c in batch.columns]).cast("decimal(20,0)")
        partial = batch.groupBy(*names).agg(F.sum(row_hash).cast("decimal(38,0)").alias("_hash"), F.count(F.lit(1)).alias("row_count"), *counts)
        partial.write.mode("overwrite").parquet(f"{state}/counts/batch={batch_id}")
        mine = spark.read.parquet(f"{state}/counts/batch={batch_id}").select(*names)

        def touched(kind: str) -> DataFrame:
            rows = spark.read.parquet(f"{state}/{kind}").drop("batch")
            same = reduce(lambda a, b: a & b, [rows[p].eqNullSafe(mine[p]) for p in parts])
            return rows.join(mine, same, "left_semi")
        sums = touched("counts")
        added = sums.groupBy(*names).agg(*[F.sum(c).alias(c) for c in sums.columns if c not in parts])
        wide = [added.drop("_hash", "row_count")]
        if keys:
            key_counts(batch, parts, keys).write.mode("overwrite").parquet(f"{state}/keys/batch={batch_id}")
            whole = touched("keys").groupBy(*names, "_k", "_a", "_b").agg(F.sum("_n").alias("_n"))
            wide.append(key_sums(whole, parts, len(keys)))
        checked = finished(beside(wide, parts), parts, rules, plans, keys)
        stamp = spark.sql("SELECT date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss.SSSSSS')").first()[0]
        store.keep(*R.shaped(checked, R.printed(added.select(*names, "_hash", "row_count")), table, parts, rules, digest, F.lit(stamp)))
    return sdf.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mask(sdf: DataFrame, plan: Sequence[M.MaskRule], master: bytes) -> DataFrame:
    """Mask in flight: stateless expressions, so any stream and any output mode."""
    return M.apply(sdf, plan, master)


def run_to_parquet(sdf: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that is available into Parquet files, then stop."""
    sdf.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append") \
        .trigger(availableNow=True).start().awaitTermination()


def monitor_to_parquet(sdf: DataFrame, table: DataFrame, ts: str, rules: Sequence[Rule], path: str, checkpoint: str, window: str = "1 day", slide: str | None = None,
                       watermark: str = "1 hour") -> DataFrame:
    """Process everything that is available, then report every window: ``closed`` ones as the stream has written them to ``path``, open ones as they stand.

    A stream emits a window once the watermark has passed its end, so the last windows of a run stay in its state.  Those are the windows that end after
    the last one written and after the watermark; their rows are read once more from ``table`` (the same data at rest), pruned by event time.  The state
    stays as it is, and a later run of the stream closes them.  Rows that arrived after the run began count in open windows only.
    """
    query = monitor(sdf, ts, rules, window, slide, watermark).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    still = monitor(table, ts, rules, window, slide)
    try:
        closed = table.sparkSession.read.schema(still.schema).parquet(path)
        last = closed.agg(F.max("window_end").alias("t")).first()["t"]
    except AnalysisException:      # nothing written yet
        closed, last = None, None
    progress = query.lastProgress
    reached = (progress or {}).get("eventTime", {}).get("watermark") if progress is None or isinstance(progress, dict) else progress["eventTime"].get("watermark")
    bounds = [F.lit(last).cast("timestamp"), F.lit(reached).cast("timestamp")]
    border = F.greatest(*bounds)
    near = table.where(border.isNull() | (_instant(table, ts) >= border - F.expr(f"INTERVAL {window}")))
    open_ = monitor(near, ts, rules, window, slide).where(border.isNull() | (F.col("window_end") > border)).withColumn("closed", F.lit(False))
    return open_ if closed is None else closed.withColumn("closed", F.lit(True)).unionByName(open_)


def _instant(df: DataFrame, ts: str):
    return col(ts).cast("timestamp")

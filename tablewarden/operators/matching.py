"""Nearest vectors, column memory and golden columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

QUERY_BLOCK, BASE_BLOCK = 20_000, 50_000      # rows of a block; more rows make more blocks, none is dropped
CELLS = 500_000                               # distances that a task holds at once, whatever the blocks


def score(distance: Column, metric: str = "cosine") -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - distance)) if metric == "cosine" else 1.0 / (1.0 + distance)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _vectors(column) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 1)


def _nearest(k: int, metric: str, exclude_self: bool):
    """The k nearest rows of a base block for each query of a query block."""
    def run(queries, base):
        import pyarrow as pa

        qids, bids = queries["qid"].to_numpy(), base["bid"].to_numpy()
        if not len(qids) or not len(bids):
            return pa.table({"qid": pa.array([], pa.int64()), "bid": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        names = {g: i for i, g in enumerate(set(queries["group"].to_pylist()) | set(base["group"].to_pylist()))}
        qgroup, bgroup = (np.array([names[g] for g in t["group"].to_pylist()]) for t in (queries, base))
        q, vectors = _unit(_vectors(queries["vector"])), _vectors(base["vector"])
        alive = np.linalg.norm(vectors, axis=1) > 0
        v = _unit(vectors)
        out = []
        step = max(1, CELLS // len(bids))
        for lo in range(0, len(qids), step):
            dot = q[lo:lo + step] @ v.T
            dist = 1.0 - dot if metric == "cosine" else np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dot))
            dist[:, ~alive] = np.inf
            dist[qgroup[lo:lo + step, None] != bgroup[None, :]] = np.inf
            if exclude_self:
                dist[qids[lo:lo + step, None] == bids[None, :]] = np.inf
            keep = np.lexsort((np.broadcast_to(bids, dist.shape), dist), axis=1)[:, :k] if dist.shape[1] <= 4 * k else _least(dist, bids, k)
            best = np.take_along_axis(dist, keep, 1)
            rows, cols = np.nonzero(np.isfinite(best))
            out.append((qids[lo:lo + step][rows], bids[keep[rows, cols]], best[rows, cols]))
        return pa.table({n: pa.array(np.concatenate([o[i] for o in out])) for i, n in enumerate(("qid", "bid", "distance"))})

    return run


def _least(dist: np.ndarray, bids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least (distance, id) of every row; rows where ids decide at the border are sorted whole."""
    part = np.argpartition(dist, k - 1, axis=1)[:, :k]
    border = np.take_along_axis(dist, part, 1).max(axis=1)
    order = np.take_along_axis(part, np.lexsort((bids[part], np.take_along_axis(dist, part, 1)), axis=1), 1)
    for r in np.flatnonzero((dist <= border[:, None]).sum(axis=1) > k):
        near = np.flatnonzero(dist[r] <= border[r])
        order[r] = near[np.lexsort((bids[near], dist[r, near]))][:k]
    return order


def knn(queries: DataFrame, base: DataFrame, k: int = 5, metric: str = "cosine", exclude_self: bool = False, query_block: int = QUERY_BLOCK, base_block: int = BASE_BLOCK) -> DataFrame:
    """Exact k nearest: queries (qid, vector[, group]) against base (bid, vector[, group]); only equal groups compare.

    Both sides stay rows: they are cut into blocks by hash, every block of queries meets every block of the base in one task, which multiplies two
    matrices of bounded size and keeps k rows a query, and the bests of all base blocks are ranked.  Nothing passes through the driver but two counts.
    """
    q = queries.select("qid", "vector", (F.col("group") if "group" in queries.columns else F.lit(None)).cast("string").alias("group"))
    b = base.select("bid", "vector", (F.col("group") if "group" in base.columns else F.lit(None)).cast("string").alias("group"))
    rows = base.count()
    n_q = max(1, -(-queries.count() // query_block))
    # at least as many base blocks as the session has shuffle tasks, if they hold a thousand rows each
    n_b = max(1, -(-rows // base_block), min(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // 1_000) // n_q)
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt_q = q.withColumn("_q", place("qid", n_q)).withColumn("_b", every(n_b))
    dealt_b = b.withColumn("_b", place("bid", n_b)).withColumn("_q", every(n_q))
    found = dealt_q.groupBy("_q", "_b").cogroup(dealt_b.groupBy("_q", "_b")).applyInArrow(_nearest(k, metric, exclude_self), "qid bigint, bid bigint, distance double")
    w = W.partitionBy("qid").orderBy("distance", "bid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("score", score(F.col("distance"), metric))


def infer(fingerprints: DataFrame, golden: DataFrame, k: int = 5, min_score: float = 0.8) -> DataFrame:
    """Governance of similar golden columns (bid, classification, entity_type) for each fingerprint."""
    hits = knn(fingerprints, golden, k).where(F.col("score") >= min_score)
    return hits.join(golden.select("bid", "classification", "entity_type"), "bid")


def promote(approved: DataFrame, golden: DataFrame, min_signal: float = 0.0) -> DataFrame:
    """Approved columns with enough fingerprint signal replace their golden row, or join."""
    good = approved.where((F.col("signal") > min_signal) & F.col("approved")).select(*golden.columns)
    keys = ["table_name", "column"]
    return golden.join(good.select(*keys), keys, "left_anti").unionByName(good)


def memory_search(queries: DataFrame, memory: DataFrame, k: int = 5, min_similarity: float = 0.0, keys: Sequence[str] = ("logical_type",)) -> DataFrame:
    """Similar remembered columns; only rows that agree on the filter columns compare. Many queries at once."""
    group = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in keys])
    hits = knn(queries.withColumn("group", group), memory.withColumn("group", group), k)
    return hits.withColumn("similarity", 1.0 - F.col("distance")).where(F.col("similarity") >= min_similarity)


def canonical_key(name: Column, logical_type: Column, signature: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat_ws("|", plain, logical_type, signature)


def memory_upsert(new: DataFrame, memory: DataFrame) -> DataFrame:
    """Merge new sightings (key, embedding, decision, seen_at) into the memory: counts add, decisions append."""
    fresh = new.groupBy("key").agg(F.count(F.lit(1)).alias("add"), F.max_by("embedding", "seen_at").alias("new_embedding"),
                                   F.transform(F.array_sort(F.collect_list(F.struct("seen_at", "decision"))), lambda d: d["decision"]).alias("new_decisions"))
    return memory.join(fresh, "key", "full").select(
        "key", F.coalesce("new_embedding", "embedding").alias("embedding"),
        F.concat(F.coalesce("decisions", F.array().cast("array<string>")), F.coalesce("new_decisions", F.array().cast("array<string>"))).alias("decisions"),
        (F.coalesce("occurrence_count", F.lit(0)) + F.coalesce("add", F.lit(0))).alias("occurrence_count"), F.col("occurrence_count").isNull().alias("created"))


def facts(catalog: DataFrame, pushdown: DataFrame, sample: DataFrame, names: Sequence[str] = ("ndv", "num_nulls", "min", "max")) -> DataFrame:
    """Each fact from the best source that has it: catalogue, then query, then sample; with its source."""
    out = catalog.select("column", *[F.col(n).alias(f"c_{n}") for n in names]) \
        .join(pushdown.select("column", *[F.col(n).alias(f"p_{n}") for n in names]), "column", "full") \
        .join(sample.select("column", *[F.col(n).alias(f"s_{n}") for n in names]), "column", "full")
    cols: list[Column] = []
    for n in names:
        cols += [F.coalesce(f"c_{n}", f"p_{n}", f"s_{n}").alias(n),
                 F.when(F.col(f"c_{n}").isNotNull(), "catalog").when(F.col(f"p_{n}").isNotNull(), "query").when(F.col(f"s_{n}").isNotNull(), "sample").alias(f"{n}_source")]
    return out.select("column", *cols)

"""A Merkle manifest of a table: one tree for each part, one tree over the parts' roots, and for every row the siblings that prove it.

Rows get a rank in their part.  The rank's digits are columns, and the number made of the higher digits is the block.  Inside a block the lowest digit is grouped
away first: its nodes become the children inside one struct, whose hash is theirs together; then the next digit, until a block is one nested struct.
Block roots are the rows of the next, smaller table, which is rolled up the same way.  On the way down a union and one grouping by block put a block beside
what lies above it, and a transform through the nested struct with one explode hands every child its siblings.  No join makes proofs.

Blocks hold ``arity ** levels`` rows, so no task or row grows with a part, be it a third of the table.

* Nulls: a null field is ``-`` in the leaf, a null part is a part of its own (the first), null keys come first.
* Ties and repeated rows: rows of equal keys are ordered by leaf; equal rows are leaves of their own.  Every row of the input is one row of the result.
* Empty texts and very long ones are hashed whole.  An empty table gives an empty manifest.  Columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tablewarden.llm.common import written

ARITY, LEVELS = 2, 8          # children of a node, levels inside a block
_PLACE = (1 << 33) - 1        # bits of monotonically_increasing_id that count the rows of a task


def field(c: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def proof(path: Column) -> Column:
    """Hash of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``_n`` (rows of the ``_part``) and ``_rank`` (from 0 in the order of ``order``); a part may hold all rows.

    Rows are range-partitioned and written, so that places stay when a lost task runs again; one small row for each task and part carries the counts across.
    """
    rows = written(rows, "merkle-rows").withColumn("_tie", F.monotonically_increasing_id())
    keys = ["_part", *order, "_tie"]
    by = [F.col(f"`{k}`").asc_nulls_first() for k in keys]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("_tie").select(
        "*", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)).alias("_place"))
    dealt = written(dealt, "merkle-places")
    runs = dealt.groupBy("_part", "_task").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_count"))
    part = W.partitionBy("_part")
    before = F.coalesce(F.sum("_count").over(part.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_part", "_task", (before - F.col("_first")).alias("_shift"), F.sum("_count").over(part).alias("_n"))
    return dealt.join(runs, ["_part", "_task"]).withColumn("_rank", F.col("_place") + F.col("_shift")).drop("_task", "_place", "_shift")


def _rolled(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """(_part, _n, _rank, _h, _own) as blocks: _part, _n, _block and the nested struct ``_node``; _h is the block's root."""
    digits = [F.pmod(F.floor(F.col("_rank") / F.lit(arity ** k)), F.lit(arity)).cast("int").alias(f"_d{k}") for k in range(levels)]
    rows = nodes.select("_part", "_n", F.floor(F.col("_rank") / F.lit(arity ** levels)).alias("_block"), *digits, F.struct(F.col("_h").alias("h"), F.col("_own").alias("own")).alias("_node"))
    rows = rows.repartition("_part", "_block")
    for k in range(levels):
        held = F.collect_list(F.struct(F.col(f"_d{k}").alias("digit"), F.col("_node").alias("node")))
        kids = F.transform(F.array_sort(held, lambda a, b: a["digit"] - b["digit"]), lambda x: x["node"])
        rows = rows.groupBy("_part", "_n", "_block", *[f"_d{j}" for j in range(k + 1, levels)]).agg(kids.alias("_kids"))
        joined = digest(F.array_join(F.transform("_kids", lambda x: x["h"]), ""))
        # a part of up to arity ** k rows is one node already
        rows = rows.withColumn("_node", F.struct(F.when(F.col("_n") > arity ** k, joined).otherwise(F.col("_kids")[0]["h"]).alias("h"), F.col("_kids").alias("kids"))).drop("_kids")
    return rows.select("_part", "_n", "_block", F.col("_node.h").alias("_h"), "_node")


def _spread(node: Column, path: Column, k: int, arity: int) -> Column:
    """The leaves of a nested struct with their paths, lowest level first."""
    if k < 0:
        return F.array(F.struct(node["own"].alias("own"), node["h"].alias("h"), path.alias("path")))
    kids = node["kids"]
    text = lambda part: F.array_join(F.transform(part, lambda x: x["h"]), "")

    def child(kid: Column, i: Column) -> Column:
        here = F.struct(text(F.slice(kids, F.lit(1), i)).alias("left"), text(F.slice(kids, i + 2, F.lit(arity))).alias("right"))
        return _spread(kid, F.when(F.col("_n") > arity ** k, F.concat(F.array(here), path)).otherwise(path), k - 1, arity)

    return F.flatten(F.transform(kids, child))


def _climb(nodes: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """Written block tables, from the leaves up to the one where every part is one block."""
    tables, size = [], arity ** levels
    while True:
        blocks = written(_rolled(nodes, arity, levels), "merkle-blocks")
        tables.append(blocks)
        if (blocks.agg(F.max("_block")).first()[0] or 0) == 0:
            return tables
        nodes = blocks.select("_part", F.ceil(F.col("_n") / F.lit(size)).alias("_n"), F.col("_block").alias("_rank"), "_h", F.col("_block").alias("_own"))


def _descend(tables: list[DataFrame], above: DataFrame, arity: int, levels: int) -> DataFrame:
    """``above`` (_part, _block, _above with the path so far) handed down to the leaves: _part, own, h, _above."""
    for blocks in reversed(tables):
        both = blocks.select("_part", "_block", "_n", "_node").unionByName(above, allowMissingColumns=True)
        held = both.groupBy("_part", "_block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("_n", "_node", "_above")])
        found = held.select("_part", "_above", F.explode(_spread(F.col("_node"), F.col("_above.path"), levels - 1, arity)).alias("_leaf"))
        rows = found.select("_part", F.col("_leaf.own").alias("own"), F.col("_leaf.h").alias("h"), F.col("_above").withField("path", F.col("_leaf.path")).alias("_above"))
        above = rows.select("_part", F.col("own").alias("_block"), "_above")
    return rows


def manifest(df: DataFrame, part: str, order: Sequence[str], leaf: Column, carry: dict[str, Column] | None = None, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``df``: the columns ``order`` and ``carry``, leaf, subroot (root of its part), root, and ``path``, from the leaf's level up.

    ``path`` is an array of (left, right): the hex hashes of the run's other nodes before and after the node, ``fold`` makes the root from it.
    Leaves lie in ascending ``order``, ties by leaf; parts lie in the order of their text, null first.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col(f"`{part}`").cast("string")), F.lit(""))
    own = F.struct(*[F.col(f"`{k}`") for k in order], *[c.alias(n) for n, c in (carry or {}).items()])
    rows = df.select(named.alias("_part"), own.alias("_own"), leaf.alias("_h"), *[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(order)])
    keys = [f"_key{i}" for i in range(len(order))]
    tables = _climb(ranked(rows, [*keys, "_h"]).drop(*keys), arity, levels)
    subroots = tables[-1].select(F.lit("").alias("_part"), F.col("_part").alias("_own"), "_h")
    parts = _climb(ranked(subroots, ["_own"]), arity, levels)
    empty = F.array().cast("array<struct<left:string,right:string>>")
    top = parts[-1].select("_part", F.col("_block").cast("bigint").alias("_block"), F.struct(F.col("_h").alias("root"), empty.alias("path")).alias("_above"))
    tops = _descend(parts, top, arity, levels).select(F.col("own").alias("_part"), F.lit(0).cast("bigint").alias("_block"),
                                                      F.struct(F.col("_above.root").alias("root"), F.col("h").alias("subroot"), F.col("_above.path").alias("path")).alias("_above"))
    found = _descend(tables, tops, arity, levels)
    return found.select("own.*", F.col("h").alias("leaf"), "_above.subroot", "_above.root", "_above.path")

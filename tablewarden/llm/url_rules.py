"""URL filters as a sort-merge range join.

A host is turned round (``www.example.net`` becomes ``net.example.www.``), so a rule for a host and all its
subdomains is an interval of keys, and the intervals of any two rules are nested or apart.  The borders of all
intervals cut the keys into segments; a sweep over the sorted borders keeps the stack of rules that are open.
The segments (two for each rule at most) and the urls are sorted together, and every url takes the stack of the last
segment that starts at or before its key.  Of that stack, the longest rule whose path starts the url's path wins.

Every sweep holds all segments and a hashed share of the urls, so a hot host is spread over all sweeps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tablewarden.llm.common import ascii_lower

Rule = tuple[str, str, str]                     # verdict, host, path (from the first slash on)
MAX_RULES = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` the host up to ``/ ? #``, then the path up to ``? #``; both empty without ``://`` or url."""
    part = [F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit("")) for k in (1, 2)]
    return ascii_lower(part[0]), part[1]


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def segments(rules: Sequence[Rule]) -> list[tuple[str, list[Rule]]]:
    """(first key, open rules from short to long) of every stretch of keys, found by one sweep over the sorted borders."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    opened: dict[str, list[Rule]] = {}
    for rule in dict.fromkeys(rules):
        opened.setdefault(".".join(reversed(rule[1].lower().split("."))) + ".", []).append(rule)
    borders = sorted({b for start in opened for b in (start, start[:-1] + "/")}, key=lambda s: s.encode())
    out, stack = [("", [])], []
    for border in borders:
        while stack and stack[-1][:-1].encode() + b"/" <= border.encode():
            stack.pop()
        if border in opened:
            stack.append(border)
        out.append((border, sorted((r for s in stack for r in opened[s]), key=lambda r: (len(r[1]) + len(r[2]), len(r[1])))))
    return out


def judge(df: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict (columns of these names are replaced).

    A null or empty url, or one without ``://``, has an empty host and path and gets the default verdict.  Repeated rows
    are judged alike and all kept.  Of rules of equal length the one with the longer host wins.
    """
    spark = df.sparkSession
    host, path = host_and_path(F.col(f"`{url}`"))
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    sweeps = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if kind in ("string", "bigint", "int") and c in kept]), F.lit(sweeps))
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    urls = df.select(share.alias("_sweep"), host.alias("host"), path.alias("path"), row.alias("_row")).select(
        "_sweep", reversed_key(F.col("host")).alias("_key"), F.lit(1).alias("_kind"), "host", "path", "_row")
    open_rules = F.array(*[
        F.struct(F.lit(start).alias("_key"), F.array(*[
            F.struct(F.lit(v).alias("verdict"), F.lit(p).alias("path"), F.lit(h + p).alias("rule")) for v, h, p in stack
        ]).cast("array<struct<verdict:string,path:string,rule:string>>").alias("_stack"))
        for start, stack in segments(rules)])
    borders = spark.range(sweeps).select(F.col("id").alias("_sweep"), F.explode(open_rules).alias("s")).select(
        "_sweep", "s._key", F.lit(0).alias("_kind"), "s._stack")
    sweep = W.partitionBy("_sweep").orderBy("_key", "_kind").rowsBetween(W.unboundedPreceding, 0)
    swept = borders.unionByName(urls, allowMissingColumns=True).withColumn("_stack", F.last("_stack", ignorenulls=True).over(sweep)).where("_kind = 1")
    return swept.withColumn("_best", F.try_element_at(F.filter("_stack", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(-1))).select(
        *[F.col("_row").getField(c).alias(c) for c in kept], "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))

"""Stored validation results: runs, rule results and rule sets, and the queries consumers ask of them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions.columns import col
from tablewarden.operators.rules import Rule, validate_by

RUN_COLUMNS = ["table_name", "partition", "partition_column", "partition_value", "partition_ts", "partition_date",
               "run_id", "validated_at", "data_fingerprint", "rule_set_digest", "contract_version", "engine",
               "row_count", "rules_total", "rules_passed", "p1_failed", "status", "error"]
RESULT_COLUMNS = ["table_name", "partition", "partition_column", "partition_value", "partition_ts",
                  "partition_date", "run_id", "validated_at", "rule_set_digest", "rule_id", "rule_type",
                  "expectation", "column_name", "severity", "owner", "passed", "unexpected_count", "observed",
                  "sample", "message"]
RUN_KEY = ["table_name", "partition", "data_fingerprint", "rule_set_digest"]


def partition_spec(p: Column) -> Column:
    """A partition text (``dt=2024-01-02/hour=05``, ``20240102`` or a bare value) → names, values, ts, date."""
    parts = F.split(p, "/")
    names = F.transform(parts, lambda x: F.when(x.contains("="), F.split_part(x, F.lit("="), F.lit(1))).otherwise(""))
    values = F.transform(parts, lambda x: F.when(x.contains("="), F.split_part(x, F.lit("="), F.lit(2))).otherwise(x))
    day = F.array_compact(F.transform(values, lambda v: F.coalesce(
        F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(v, 1, 10), "yyyy-MM-dd")),
        F.when(v.rlike(r"^(19|20)\d{6}$"), F.try_to_date(v, "yyyyMMdd")))))
    hours = F.filter(parts, lambda x: x.rlike(r"^(hour|hr|h)=\d{1,2}$"))
    hour = F.coalesce(F.try_element_at(F.split(F.get(hours, F.lit(0)), "="), F.lit(2)).try_cast("int"), F.lit(0))
    first = F.get(day, F.lit(0))
    stamp = F.coalesce(
        F.try_to_timestamp(F.get(values, F.lit(0)), F.lit("yyyy-MM-dd HH:mm:ss")),
        F.when(first.isNotNull(), first.cast("timestamp") + F.make_dt_interval(F.lit(0), hour)))
    return F.struct(F.array_join(F.filter(names, lambda n: n != ""), ",").alias("partition_column"),
                    F.array_join(values, ",").alias("partition_value"),
                    stamp.alias("partition_ts"), first.alias("partition_date"))


def partition_text(parts: Sequence[str]) -> Column:
    """``name=value/name=value`` of the partition columns."""
    return F.concat_ws("/", *[F.concat(F.lit(f"{p}="), col(p).cast("string")) for p in parts])


def fingerprint(df: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
    """Content hash per partition, independent of row order and of how rows are split over tasks."""
    row_hash = F.xxhash64(*[col(c) for c in df.columns])
    return printed(df.groupBy(*[col(p) for p in parts]).agg(F.sum(row_hash.cast("decimal(20,0)")).alias("_hash"), F.count(F.lit(1)).alias("row_count")))


def printed(sums: DataFrame) -> DataFrame:
    """Sums of row hashes (``_hash``; decimals cannot overflow at any table size) and ``row_count`` as fingerprints."""
    digest = F.sha2(F.concat_ws("|", F.col("_hash").cast("string"), F.col("row_count").cast("string")), 256)
    return sums.select(*[col(c) for c in sums.columns if c not in ("_hash", "row_count")], digest.alias("data_fingerprint"), "row_count")


def snapshot_fingerprint(spark: SparkSession, table: str) -> str:
    """The newest snapshot id of a table format that keeps snapshots."""
    return str(spark.sql(f"SELECT snapshot_id FROM {table}.snapshots ORDER BY committed_at DESC LIMIT 1").first()[0])


def record(df: DataFrame, table: str, parts: Sequence[str], rules: Sequence[Rule], rule_set_digest: str,
           validated_at: Column, contract_version: str = "", engine: str = "spark") -> tuple[DataFrame, DataFrame]:
    """Validate every partition in one job → (rule_results, partition_runs) in the stored shape."""
    return shaped(validate_by(df, parts, rules), fingerprint(df, parts), table, parts, rules, rule_set_digest, validated_at, contract_version, engine)


def shaped(checked: DataFrame, prints: DataFrame, table: str, parts: Sequence[str], rules: Sequence[Rule], rule_set_digest: str,
           validated_at: Column, contract_version: str = "", engine: str = "spark") -> tuple[DataFrame, DataFrame]:
    """Rule rows and fingerprints per partition → (rule_results, partition_runs) in the stored shape."""
    spec = partition_spec(F.col("partition"))
    checked = checked.withColumn("partition", partition_text(parts)).drop(*parts)
    prints = prints.withColumn("partition", partition_text(parts)).drop(*parts)
    owners = {r.rule_id: r.owner for r in rules}
    owner = F.lit("")
    for rid, name in owners.items():
        if name:
            owner = F.when(F.col("rule_id") == rid, name).otherwise(owner)
    base = checked.join(prints, "partition").withColumn("_s", spec).select(
        F.lit(table).alias("table_name"), "partition", "_s.*",
        F.substring(F.sha2(F.concat_ws("|", F.lit(table), "partition", "data_fingerprint", F.lit(rule_set_digest),
                                       validated_at.cast("string")), 256), 1, 32).alias("run_id"),
        validated_at.cast("timestamp").alias("validated_at"), "data_fingerprint", "row_count",
        F.lit(rule_set_digest).alias("rule_set_digest"), "rule_id", "expectation", "column_name", "severity",
        owner.alias("owner"), F.col("success").alias("passed"), "unexpected_count", "observed_value",
        "observed_text", "reason")
    results = base.select(
        *[c for c in RESULT_COLUMNS if c in base.columns], F.col("expectation").alias("rule_type"),
        F.coalesce("observed_text", F.col("observed_value").cast("string")).alias("observed"),
        F.lit(None).cast("string").alias("sample"), F.col("reason").alias("message")).select(*RESULT_COLUMNS)
    keys = ["table_name", "partition", "partition_column", "partition_value", "partition_ts", "partition_date",
            "run_id", "validated_at", "data_fingerprint", "rule_set_digest", "row_count"]
    runs = base.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("rules_total"),
        F.count_if("passed").cast("int").alias("rules_passed"),
        F.count_if(~F.col("passed") & (F.col("severity") == "P1")).cast("int").alias("p1_failed"))
    runs = runs.withColumn("status", F.when(F.col("rules_passed") == F.col("rules_total"), "passed").otherwise("failed")) \
        .withColumn("contract_version", F.lit(contract_version)).withColumn("engine", F.lit(engine)) \
        .withColumn("error", F.lit("")).select(*RUN_COLUMNS)
    return results, runs


def only_new(runs: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Runs whose (table, partition, fingerprint, digest) is not stored yet."""
    return runs if force else runs.join(stored.select(*RUN_KEY).distinct(), RUN_KEY, "left_anti")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of every partition; ``max_by`` combines before the shuffle."""
    keys = ["table_name", "partition"]
    rest = [c for c in runs.columns if c not in keys]
    best = runs.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("validated_at", "run_id")).alias("r"))
    return best.select(*keys, "r.*")


def latest(runs: DataFrame, results: DataFrame) -> DataFrame:
    """The results of the newest run of the newest partition (unknown times last)."""
    newest = runs.groupBy("table_name").agg(F.max_by("run_id", F.struct(
        F.coalesce("partition_ts", F.lit("0001-01-01").cast("timestamp")),
        F.coalesce("partition_date", F.lit("0001-01-01").cast("date")), "validated_at")).alias("run_id"))
    return results.join(newest, ["table_name", "run_id"], "left_semi")


def results_of(results: DataFrame, run_ids: DataFrame, rule_ids: Sequence[str] | None = None) -> DataFrame:
    out = results.join(run_ids.select("run_id").distinct(), "run_id", "left_semi")
    return out.where(F.col("rule_id").isin(list(rule_ids))) if rule_ids is not None else out


def newest_rule_set(rule_sets: DataFrame) -> DataFrame:
    newest = rule_sets.groupBy("table_name").agg(F.max_by("rule_set_digest", "created_at").alias("rule_set_digest"))
    return rule_sets.join(newest, ["table_name", "rule_set_digest"], "left_semi")


def new_rule_sets(candidate: DataFrame, stored: DataFrame) -> DataFrame:
    """A rule set is stored once per digest."""
    keys = ["table_name", "rule_set_digest"]
    return candidate.join(stored.select(*keys).distinct(), keys, "left_anti")


def read_filter(df: DataFrame, equals: dict[str, Any] | None = None, isin: dict[str, Sequence[Any]] | None = None,
                date_from: date | str | None = None, date_to: date | str | None = None) -> DataFrame:
    """Filters that reach the Parquet scan."""
    for k, v in (equals or {}).items():
        df = df.where(col(k) == F.lit(v))
    for k, vs in (isin or {}).items():
        df = df.where(col(k).isin(list(vs)))
    if date_from is not None:
        df = df.where(F.col("partition_date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        df = df.where(F.col("partition_date") <= F.lit(date_to).cast("date"))
    return df


def rule_catalog(rule_sets: DataFrame) -> DataFrame:
    """What consumers may select from: the newest rule set of every table."""
    return newest_rule_set(rule_sets).select("table_name", "rule_id", "rule_type", "expectation", "column_name",
                                             "severity", "owner", "description")

"""Consumer gates: may a reader use the partitions of a table, judged from stored results only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.operators.results import latest_runs


@dataclass(frozen=True)
class Selection:
    """Rule ids, or filters that all must hold; nothing given means every rule."""

    ids: Sequence[str] = ()
    columns: Sequence[str] = ()
    types: Sequence[str] = ()
    severities: Sequence[str] = ()
    owners: Sequence[str] = ()

    def condition(self) -> Column:
        filters = F.lit(True)
        given = False
        for name, values in (("column_name", self.columns), ("expectation", self.types), ("severity", self.severities)):
            if values:
                given, filters = True, filters & F.col(name).isin(list(values))
        if self.owners:
            owns = F.lit(False)
            for o in self.owners:
                owns = owns | F.col("owner").contains(o)
            given, filters = True, filters & owns
        if self.ids:
            named = F.col("rule_id").isin(list(self.ids))
            return named | filters if given else named
        return filters


@dataclass(frozen=True)
class Window:
    today: bool = False
    last_days: int | None = None
    since: str | None = None
    partitions: Sequence[str] = field(default_factory=tuple)
    latest: int | None = None

    def expected(self, runs: DataFrame, as_of: str) -> DataFrame:
        """(partition_date or partition) the consumer needs, as rows."""
        spark = runs.sparkSession
        end = F.lit(as_of).cast("date")
        if self.partitions:
            return spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in self.partitions])).alias("partition"))
        if self.today or self.last_days is not None or self.since is not None:
            start = end if self.today else (
                F.lit(self.since).cast("date") if self.since is not None else F.date_sub(end, self.last_days))
            return spark.range(1).select(F.explode(F.sequence(start, end)).alias("partition_date"))
        # the newest N partitions: a top-N over one small row per partition
        return latest_runs(runs).orderBy(
            F.col("partition_ts").desc_nulls_last(), F.col("partition_date").desc_nulls_last(),
            F.col("partition").desc()).limit(self.latest or 1).select("partition")


def select_rules(rule_set: DataFrame, sel: Selection) -> DataFrame:
    return rule_set.where(sel.condition())


def verdicts(runs: DataFrame, results: DataFrame, rule_set: DataFrame, window: Window, sel: Selection,
             as_of: str) -> DataFrame:
    """passed / failed / missing / incomplete for every expected partition."""
    expected = window.expected(runs, as_of)
    key = expected.columns[0]
    newest = latest_runs(runs).select("partition", "partition_date", "run_id", "rule_set_digest")
    slots = expected.join(newest, key, "left").withColumn(
        "partition", F.coalesce("partition", F.col(key).cast("string")))
    wanted = rule_set.where(sel.condition()).select("rule_set_digest", "rule_id").distinct()
    wanted_counts = wanted.groupBy("rule_set_digest").agg(F.count(F.lit(1)).alias("required"))
    checked = results.select("run_id", "rule_set_digest", "rule_id", "passed") \
        .join(wanted, ["rule_set_digest", "rule_id"], "left_semi") \
        .groupBy("run_id").agg(F.count_if("passed").alias("ok"), F.count_if(~F.col("passed")).alias("bad"))
    # explicitly named rules the digest does not have make the partition incomplete
    absent = F.lit(0)
    if sel.ids:
        have = rule_set.where(F.col("rule_id").isin(list(sel.ids))).groupBy("rule_set_digest") \
            .agg(F.count_distinct("rule_id").alias("named"))
        wanted_counts = wanted_counts.join(have, "rule_set_digest", "left")
        absent = F.lit(len(set(sel.ids))) - F.coalesce("named", F.lit(0))
    joined = slots.join(wanted_counts, "rule_set_digest", "left").join(checked, "run_id", "left")
    required, ok, bad = (F.coalesce(c, F.lit(0)) for c in ("required", "ok", "bad"))
    status = F.when(F.col("run_id").isNull(), "missing").when(bad > 0, "failed") \
        .when((required == 0) | (absent > 0) | (ok + bad < required), "incomplete").otherwise("passed")
    return joined.select("partition", F.coalesce(
        "partition_date", F.try_to_date(F.split_part("partition", F.lit("="), F.lit(-1)), "yyyy-MM-dd"))
        .alias("partition_date"), "run_id", required.alias("rules_required"), bad.alias("rules_failed"),
        status.alias("status"))


def decide(verdict_rows: DataFrame, require: str = "all", on_missing: str = "block") -> DataFrame:
    """One decision row from the verdicts of a window."""
    counted = F.lit(True) if on_missing == "block" else F.col("status") != "missing"
    good = F.col("status") == "passed"
    row = verdict_rows.where(counted).agg(
        F.count(F.lit(1)).alias("considered"), F.count_if(good).alias("passed"),
        F.max_by("status", F.struct("partition_date", "partition")).alias("last_status"))
    accepted = {"all": F.col("passed") == F.col("considered"), "any": F.col("passed") > 0,
                "latest": F.col("last_status") == "passed"}[require]
    ok = (F.col("considered") > 0) & F.coalesce(accepted, F.lit(False))
    reason = F.when(F.col("considered") == 0, "no validated partition in the window") \
        .otherwise(F.concat(F.col("passed").cast("string"), F.lit(" of "), F.col("considered").cast("string"),
                            F.lit(" partition(s) passed")))
    return row.select(ok.alias("accepted"), F.col("considered"), F.col("passed"), "last_status", reason.alias("reason"))


def accepted_rows(df: DataFrame, verdict_rows: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Only rows of accepted partitions: a semi join on every partition column, so partition pruning reaches the scan.

    A verdict whose partition (``dt=2024-01-01/hour=05``) names other columns than these is an error, not an empty result.
    """
    names = [columns] if isinstance(columns, str) else list(columns)
    spec = F.str_to_map("partition", F.lit("/"), F.lit("="))
    fits = F.array_sort(F.map_keys("_spec")) == F.array_sort(F.array(*[F.lit(n) for n in names]))
    value = lambda n: F.when(F.col("status") != "passed", None).when(fits, F.try_element_at("_spec", F.lit(n))).otherwise(F.raise_error(F.concat(F.lit("partition columns differ: "), F.col("partition"))))
    good = verdict_rows.where("status = 'passed'").withColumn("_spec", spec).select(*[value(n).alias(f"_p{i}") for i, n in enumerate(names)]).distinct()
    return df.join(good, reduce(lambda a, b: a & b, [F.col(n).cast("string") == F.col(f"_p{i}") for i, n in enumerate(names)]), "left_semi")


def with_consumer_rules(rules: Sequence[dict], consumer_rules: dict[str, Sequence[dict]]) -> list[dict]:
    """A producer run also checks what its consumers ask for; the owner is kept with each rule."""
    return [*rules, *[{**r, "owner": owner} for owner, rs in consumer_rules.items() for r in rs]]

"""Rules as rows: discovery, contract mapping, ids, relaxing, diff, merge and overlays.

Rule rows are ``(table_name, column_name, expectation, kwargs)`` with ``kwargs`` as JSON text, so whole
folders of contracts and drafts are handled by joins and expressions; ``to_rules`` turns the few rows of one
table into rule objects for a validation.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.columns import let
from tablewarden.operators.rules import Rule

# fixed values
SNAPSHOT_TYPES = [
    "table_row_count_to_equal", "table_row_count_to_be_between", "column_unique_value_count_to_be_between",
    "column_min_to_be_between", "column_max_to_be_between", "column_mean_to_be_between",
    "column_median_to_be_between", "column_stdev_to_be_between", "column_quantile_values_to_be_between",
    "column_proportion_of_unique_values_to_be_between",
]
SAFE_CONTRACT_RULES = ["missingCount", "duplicateCount", "nullCount"]
VALUE_BEARING = r"_min_|_max_|_between|value_set|values_to_be_in_set|quantile|median|mean|stdev|value_lengths|most_common"


def to_rules(rows: DataFrame) -> list[Rule]:
    """The rules of one table as objects (control data: a few rows per column of a table)."""
    return [Rule(r["expectation"], r["column_name"] or None, json.loads(r["kwargs"] or "{}"),
                 (r.asDict().get("severity") or "P2"), (r.asDict().get("owner") or ""))
            for r in rows.collect()]


def rule_rows(spark, rules: Sequence[Rule], table: str) -> DataFrame:
    data = [(table, r.column or "", r.kind, json.dumps(r.kwargs, sort_keys=True, default=str), r.severity, r.owner)
            for r in rules]
    rows = spark.createDataFrame(
        data, "table_name string, column_name string, expectation string, kwargs string, severity string, owner string")
    return rows.withColumn("rule_id", rule_id())


def rule_id(expectation: str = "expectation", column: str = "column_name", kwargs: str = "kwargs") -> Column:
    """Short stable hash of (type, column, canonical kwargs)."""
    return F.substring(F.sha2(F.concat_ws("|", expectation, F.coalesce(column, F.lit("")), kwargs), 256), 1, 12)


def digest(rows: DataFrame) -> DataFrame:
    """One digest per table over its sorted rule ids (a table has few rules)."""
    return rows.groupBy("table_name").agg(
        F.sha2(F.concat_ws(",", F.array_sort(F.collect_set("rule_id"))), 256).alias("rule_set_digest"))


# --- discovery -------------------------------------------------------------------------------------------

def _kw(*pairs: tuple[str, Column]) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in pairs])) if pairs else F.lit("{}")


def suggest(profile: DataFrame, max_frequent: int = 10) -> DataFrame:
    """Rules from one profile row per column.

    Needs ``column, rows, null_proportion, unique_proportion, unique_count, min_value, max_value`` (double) and
    ``frequent`` (array of the most frequent values).
    """
    mostly = F.round(1 - F.col("null_proportion"), 4)
    complete = (F.col("unique_count") > 1) & (F.col("unique_count") <= max_frequent) & \
        (F.col("unique_count") <= F.size("frequent"))
    options = F.array(
        F.when((F.col("rows") > 0) & (F.col("null_proportion") < 0.05) & (mostly >= 0.5),
               F.struct(F.lit("column_values_to_not_be_null").alias("expectation"),
                        _kw(("mostly", mostly)).alias("kwargs"))),
        F.when((F.col("unique_proportion") >= 0.98) & (F.col("unique_count") > 1),
               F.struct(F.lit("column_values_to_be_unique").alias("expectation"), _kw().alias("kwargs"))),
        F.when(F.col("min_value") <= F.col("max_value"),
               F.struct(F.lit("column_values_to_be_between").alias("expectation"),
                        _kw(("min_value", F.col("min_value")), ("max_value", F.col("max_value"))).alias("kwargs"))),
        F.when(complete & (F.size("frequent") >= 2),
               F.struct(F.lit("column_values_to_be_in_set").alias("expectation"),
                        _kw(("value_set", F.array_sort("frequent"))).alias("kwargs"))),
    )
    return profile.select(F.col("column").alias("column_name"), F.inline(F.array_compact(options)))


def cover(df: DataFrame, covered: Sequence[str] = ()) -> DataFrame:
    """Baseline rules for columns no rule covers: never null, all distinct, string length range; one pass each."""
    from tablewarden.functions.columns import col, one_row, string_columns
    from tablewarden.operators.profile import distinct_counts

    names = [c for c in df.columns if c not in set(covered)]
    strings = set(string_columns(df))
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        aggs.append(F.count_if(col(c).isNull()).alias(f"n{i}"))
        if c in strings:
            aggs += [F.min(F.length(col(c))).alias(f"lo{i}"), F.max(F.length(col(c))).alias(f"hi{i}")]
    rows = one_row(df, aggs).select("rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"),
                 (F.col(f"lo{i}") if c in strings else F.lit(None).cast("int")).alias("lo"),
                 (F.col(f"hi{i}") if c in strings else F.lit(None).cast("int")).alias("hi"))
        for i, c in enumerate(names)])))
    full = rows.join(distinct_counts(df, names), "column", "left")
    key = (F.col("rows") > 0) & (F.col("nulls") == 0)
    options = F.array(
        F.when(key, F.struct(F.lit("missingCount").alias("rule"), F.lit('{"mustBe":0}').alias("definition"))),
        F.when(key & (F.col("distinct") == F.col("rows")),
               F.struct(F.lit("duplicateCount").alias("rule"), F.lit('{"mustBe":0}').alias("definition"))),
        F.when(F.col("lo").isNotNull(),
               F.struct(F.lit("column_value_lengths_to_be_between").alias("rule"),
                        _kw(("min_value", F.col("lo")), ("max_value", F.col("hi"))).alias("definition"))))
    return full.select(F.col("column").alias("column_name"), F.inline(F.array_compact(options)))


def widened(lo: Column, hi: Column, tolerance: float, whole: Column, floor: Column | None = None, ceiling: Column | None = None) -> Column:
    """[lo, hi] widened by a share of its span, never across zero, floats rounded outward to a clean step; null where a bound is missing.

    ``floor`` and ``ceiling`` are limits that the widened range keeps (null: none).
    """
    base = F.when(hi > lo, hi - lo).otherwise(F.greatest(F.abs(lo), F.abs(hi))) * tolerance

    def bounds(pad: Column) -> Column:
        step = F.pow(F.lit(10.0), F.floor(F.log10(pad)).cast("double"))
        low = F.when(lo >= 0, F.greatest(F.lit(0.0), lo - pad)).otherwise(lo - pad)
        high = F.when(hi <= 0, F.least(F.lit(0.0), hi + pad)).otherwise(hi + pad)
        return let(F.struct(step.alias("step"), low.alias("low"), high.alias("high")), lambda x: F.struct(
            F.when(whole, F.floor(x["low"]).cast("double")).otherwise(F.floor(x["low"] / x["step"] + 1e-9).cast("double") * x["step"]).alias("lo"),
            F.when(whole, F.ceil(x["high"]).cast("double")).otherwise(F.ceil(x["high"] / x["step"] - 1e-9).cast("double") * x["step"]).alias("hi")))

    def kept(x: Column) -> Column:
        return F.struct(F.round(F.greatest(x["lo"], floor) if floor is not None else x["lo"], 10).alias("lo"),
                        F.round(F.least(x["hi"], ceiling) if ceiling is not None else x["hi"], 10).alias("hi"))
    done = let(F.when(base > 0, base).otherwise(F.lit(float(tolerance))), lambda pad: let(bounds(pad), kept))
    return F.when(lo.isNotNull() & hi.isNotNull(), done)


def _merged(fresh: Column, rest: Column) -> Column:
    """A JSON object from the text of its first members and a map of the others."""
    return F.concat(F.lit("{"), fresh, F.when(F.size(rest) > 0, F.concat(F.lit(","), F.substr(F.to_json(rest), F.lit(2)))).otherwise("}"))


def relax(rows: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Widen the numeric ranges of rule rows: min / max values, quantile ranges, ``mustBeBetween``; lengths, SQL and sets stay as they are.

    Quantile ranges with an open end keep it.  Adds ``relaxed_min`` and ``relaxed_max`` for plain ranges.
    """
    kwargs = F.col("kwargs")
    open_ = ~F.col("expectation").contains("value_lengths") & (F.col("expectation") != "sql")
    text = lambda path: F.when(open_, F.get_json_object(kwargs, path))
    is_whole = lambda *cs: reduce(lambda a, b: a & b, [c.rlike(r"^-?\d+$") for c in cs])
    others = lambda *names: F.map_filter(F.from_json(kwargs, "map<string,string>"), lambda k, v: ~k.isin(*names))
    share = F.col("expectation").rlike("proportion|_percent")
    limit = lambda v: F.when(share, F.lit(v))

    parsed = rows.withColumns({"_lo": text("$.min_value"), "_hi": text("$.max_value"),
                               "_ranges": F.from_json(text("$.quantile_ranges.value_ranges"), "array<array<double>>"),
                               "_between": F.from_json(text("$.mustBeBetween"), "array<string>")})
    lo, hi = F.col("_lo").try_cast("double"), F.col("_hi").try_cast("double")
    pair = F.when(F.size("_between") == 2, F.col("_between"))
    a, b = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
    out = parsed.withColumns({
        "_plain": widened(lo, hi, tolerance, is_whole(F.col("_lo"), F.col("_hi")), limit(0.0), limit(1.0)),
        "_quantiles": F.transform("_ranges", lambda r: F.when((F.size(r) == 2) & F.get(r, F.lit(0)).isNotNull() & F.get(r, F.lit(1)).isNotNull(), let(
            widened(F.get(r, F.lit(0)), F.get(r, F.lit(1)), tolerance, F.lit(False)), lambda w: F.array(w["lo"], w["hi"]))).otherwise(r)),
        "_must": widened(a.try_cast("double"), b.try_cast("double"), tolerance, is_whole(a, b), F.when(is_whole(a, b), F.lit(0.0)))})
    number = lambda x: F.when(is_whole(a, b), x.cast("bigint").cast("string")).otherwise(x.cast("string"))
    plain = F.to_json(F.map_concat(others("min_value", "max_value"), F.create_map(
        F.lit("min_value"), F.col("_plain.lo").cast("string"), F.lit("max_value"), F.col("_plain.hi").cast("string"))))
    quantiles = _merged(F.concat(F.lit('"quantile_ranges":{"quantiles":'), F.get_json_object(kwargs, "$.quantile_ranges.quantiles"), F.lit(',"value_ranges":'), F.to_json("_quantiles"), F.lit("}")),
                        others("quantile_ranges"))
    must = _merged(F.concat(F.lit('"mustBeBetween":['), number(F.col("_must.lo")), F.lit(","), number(F.col("_must.hi")), F.lit("]")), others("mustBeBetween"))
    changed = F.when(F.col("_plain").isNotNull(), plain).when(F.col("_quantiles").isNotNull(), quantiles).when(F.col("_must").isNotNull(), must).otherwise(kwargs)
    return out.withColumns({"kwargs": changed, "relaxed_min": F.col("_plain.lo"), "relaxed_max": F.col("_plain.hi")}) \
        .drop("_lo", "_hi", "_ranges", "_between", "_plain", "_quantiles", "_must")


def drop(rows: DataFrame, columns: Sequence[str] = (), types: Sequence[str] = (), ids: Sequence[str] = (),
         snapshot: bool = False) -> DataFrame:
    """Remove rules by column, type or id; ``snapshot`` removes rules that only restate today's statistics."""
    gone = F.lit(False)
    if columns:
        gone = gone | F.col("column_name").isin(list(columns))
    if types:
        gone = gone | F.col("expectation").isin(list(types))
    if ids:
        gone = gone | F.col("rule_id").isin(list(ids))
    if snapshot:
        gone = gone | F.col("expectation").isin(SNAPSHOT_TYPES)
    return rows.where(~gone)


def value_bearing(contract_rule: Column, expectation: Column) -> Column:
    """True when a rule carries literal column values."""
    named = F.coalesce(contract_rule, F.lit("")) != ""
    return (named & ~contract_rule.isin(SAFE_CONTRACT_RULES)) | F.coalesce(expectation.rlike(VALUE_BEARING), F.lit(False))


def diff(old: DataFrame, new: DataFrame, pii_columns: DataFrame) -> DataFrame:
    """added / removed / kept / withheld per rule; only columns the new set carries are affected."""
    keys = ["table_name", "column_name", "rule_id"]
    touched = new.select("table_name", "column_name").distinct()
    before = old.join(touched, ["table_name", "column_name"], "left_semi").select(*keys, F.lit(True).alias("was"))
    guarded = pii_columns.select("table_name", "column_name", F.lit(True).alias("pii")).distinct()
    after = new.join(guarded, ["table_name", "column_name"], "left").select(
        *keys, F.lit(True).alias("now"),
        (F.coalesce("pii", F.lit(False)) & value_bearing(F.lit(""), F.col("expectation"))).alias("withheld"))
    kind = F.when(F.col("withheld"), "withheld").when(F.col("was") & F.col("now"), "kept") \
        .when(F.col("now"), "added").otherwise("removed")
    return before.join(after, keys, "full").select(*keys, kind.alias("change"))


def merge(drafts: DataFrame, key: Sequence[str], order: str, on_conflict: str = "later") -> DataFrame:
    """One rule per key: the later draft wins, or conflicting keys are reported."""
    if on_conflict == "error":
        variants = drafts.groupBy(*key).agg(F.count_distinct("kwargs").alias("variants"))
        return drafts.join(variants.where("variants > 1"), list(key), "left_semi")
    rest = [c for c in drafts.columns if c not in key]
    best = drafts.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, "kwargs")).alias("b"))
    return best.select(*key, "b.*")


def apply_decisions(rows: DataFrame, suppressed: DataFrame, manual: DataFrame) -> DataFrame:
    """Suppressed rule ids leave, manual rules join."""
    return rows.join(suppressed.select("rule_id").distinct(), "rule_id", "left_anti") \
        .unionByName(manual, allowMissingColumns=True)


def strip_value_bearing(rows: DataFrame, pii_columns: DataFrame) -> DataFrame:
    """Value-bearing rules leave the personal-data columns."""
    bearing = value_bearing(F.lit(""), F.col("expectation"))
    pii = pii_columns.select("table_name", "column_name").distinct()
    return rows.where(~bearing).unionByName(
        rows.where(bearing).join(pii, ["table_name", "column_name"], "left_anti").select(*rows.columns))


def from_pii(evidence: DataFrame, patterns: DataFrame) -> DataFrame:
    """A detected column whose best pattern is known becomes a regex rule."""
    return evidence.where("detected").join(patterns.select("pattern_name", "regex"), "pattern_name") \
        .select("table_name", F.col("column").alias("column_name"),
                F.lit("column_values_to_match_regex").alias("expectation"),
                F.to_json(F.struct("regex", F.lit(0.95).alias("mostly"))).alias("kwargs"))


# --- contracts -------------------------------------------------------------------------------------------

CONTRACT_SCHEMA = """struct<id:string, schema:array<struct<name:string, quality:array<string>,
    properties:array<struct<name:string, logicalType:string, physicalType:string, required:boolean, unique:boolean,
    classification:string, tags:array<string>, quality:array<string>>>>>>"""


CONTRACT_RULE = """struct<rule:string, unit:string, severity:string, owner:string, query:string, pattern:string,
    mustBe:double, mustBeLessThan:double, mustBeGreaterOrEqualTo:double, mustBeBetween:array<double>,
    arguments:struct<validValues:array<string>, pattern:string>,
    implementation:struct<expectation_type:string, kwargs:string>>"""


def contract_columns(docs: DataFrame) -> DataFrame:
    """One row per (table, column) of contract documents held as JSON text in ``doc``."""
    c = docs.select(F.from_json("doc", CONTRACT_SCHEMA).alias("c"))
    tables = c.select(F.explode("c.schema").alias("t"))
    return tables.select(F.col("t.name").alias("table_name"), F.posexplode("t.properties").alias("ordinal", "p")) \
        .select("table_name", F.col("p.name").alias("column_name"), "ordinal",
                F.col("p.logicalType").alias("logical_type"), F.col("p.physicalType").alias("physical_type"),
                F.col("p.required").alias("required"), F.col("p.unique").alias("unique"),
                F.col("p.classification").alias("classification"), F.col("p.tags").alias("tags"))


def from_contract(docs: DataFrame) -> DataFrame:
    """Contract rules → expectation rows, a whole folder of contracts in one job."""
    tables = docs.select(F.explode(F.from_json("doc", CONTRACT_SCHEMA)["schema"]).alias("t"))
    level = tables.select(F.col("t.name").alias("table_name"), F.lit("").alias("column_name"),
                          F.explode("t.quality").alias("q"))
    props = tables.select(F.col("t.name").alias("table_name"), F.explode("t.properties").alias("p")) \
        .select("table_name", F.col("p.name").alias("column_name"), F.explode("p.quality").alias("q"))
    q = level.unionByName(props).withColumn("p", F.from_json("q", CONTRACT_RULE))

    def g(path: str) -> Column:
        return F.col(f"p.{path}")
    rule, percent = g("rule"), F.coalesce(g("unit") == "percent", F.lit(False))
    below, at_least, be = g("mustBeLessThan"), g("mustBeGreaterOrEqualTo"), g("mustBe")
    engine = g("implementation.expectation_type").isNotNull()
    mostly_left = F.when(percent, F.round(1 - below / 100, 4))
    mostly_share = F.when(percent, F.round(at_least / 100, 4))
    expectation = (
        F.when(engine, F.regexp_replace(g("implementation.expectation_type"), "^expect_", ""))
        .when((rule == "missingCount") & percent & (be == 100), "column_values_to_be_null")
        .when(rule == "missingCount", "column_values_to_not_be_null")
        .when(rule == "duplicateCount", "column_values_to_be_unique")
        .when((rule == "rowCount") & be.isNotNull(), "table_row_count_to_equal")
        .when(rule == "rowCount", "table_row_count_to_be_between")
        .when(rule == "uniqueCount", "column_unique_value_count_to_be_between")
        .when(rule == "validValues", "column_values_to_be_in_set")
        .when(rule == "regex", "column_values_to_match_regex")
        .when(g("query").isNotNull(), "sql"))
    kwargs = (
        F.when(engine, F.coalesce(g("implementation.kwargs"), F.lit("{}")))
        .when(rule.isin("missingCount", "duplicateCount"), F.to_json(F.struct(mostly_left.alias("mostly"))))
        .when((rule == "rowCount") & be.isNotNull(), F.to_json(F.struct(be.cast("bigint").alias("value"))))
        .when(rule.isin("rowCount", "uniqueCount"), F.to_json(F.struct(
            F.coalesce(F.get("p.mustBeBetween", 0), at_least).alias("min_value"),
            F.get("p.mustBeBetween", 1).alias("max_value"))))
        .when(rule == "validValues", F.to_json(F.struct(
            g("arguments.validValues").alias("value_set"), mostly_share.alias("mostly"))))
        .when(rule == "regex", F.to_json(F.struct(
            F.coalesce(g("arguments.pattern"), g("pattern")).alias("regex"), mostly_share.alias("mostly"))))
        .otherwise(F.col("q")))
    return q.select("table_name", "column_name", expectation.alias("expectation"), kwargs.alias("kwargs"),
                    F.coalesce(g("severity"), F.lit("P1")).alias("severity"),
                    F.coalesce(g("owner"), F.lit("")).alias("owner"))


def to_contract(rows: DataFrame) -> DataFrame:
    """Expectation rows → contract rule JSON in ``definition``."""
    def g(path: str) -> Column:
        return F.get_json_object("kwargs", f"$.{path}")
    mostly = F.coalesce(g("mostly").try_cast("double"), F.lit(1.0))
    lo, hi = F.coalesce(g("min_value").try_cast("double"), F.lit(0.0)), g("max_value").try_cast("double")
    share = F.when(mostly < 1, F.round(mostly * 100, 2))
    left = F.round((1 - mostly) * 100, 2)
    pct = F.when(mostly < 1, "percent")
    e = F.col("expectation")

    def counted(name: str) -> Column:
        return F.when(mostly >= 1, F.to_json(F.struct(F.lit(name).alias("rule"), F.lit(0).alias("mustBe")))) \
            .otherwise(F.to_json(F.struct(F.lit(name).alias("rule"), left.alias("mustBeLessThan"),
                                          F.lit("percent").alias("unit"))))

    def ranged(name: str) -> Column:
        return F.when(hi.isNotNull(), F.to_json(F.struct(F.lit(name).alias("rule"), F.array(lo, hi).alias("mustBeBetween")))) \
            .otherwise(F.to_json(F.struct(F.lit(name).alias("rule"), lo.alias("mustBeGreaterOrEqualTo"))))
    definition = (
        F.when(e == "column_values_to_not_be_null", counted("missingCount"))
        .when(e == "column_values_to_be_null", F.lit('{"rule":"missingCount","mustBe":100,"unit":"percent"}'))
        .when(e == "column_values_to_be_unique", counted("duplicateCount"))
        .when(e == "table_row_count_to_equal", F.to_json(F.struct(
            F.lit("rowCount").alias("rule"), g("value").try_cast("bigint").alias("mustBe"))))
        .when(e == "table_row_count_to_be_between", ranged("rowCount"))
        .when(e == "column_unique_value_count_to_be_between", ranged("uniqueCount"))
        .when(e == "column_values_to_be_in_set", F.to_json(F.struct(
            F.lit("validValues").alias("rule"),
            F.struct(F.from_json(g("value_set"), "array<string>").alias("validValues")).alias("arguments"),
            share.alias("mustBeGreaterOrEqualTo"), pct.alias("unit"))))
        .when(e == "column_values_to_match_regex", F.to_json(F.struct(
            F.lit("regex").alias("rule"), F.struct(g("regex").alias("pattern")).alias("arguments"),
            share.alias("mustBeGreaterOrEqualTo"), pct.alias("unit"))))
        .otherwise(F.concat(F.lit('{"engine":"greatExpectations","implementation":{"expectation_type":"expect_'), e,
                            F.lit('","kwargs":'), F.col("kwargs"), F.lit("}}"))))
    return rows.withColumn("definition", definition)


def as_contract_rule(r: Rule) -> dict[str, Any]:
    return {"expectation_type": f"expect_{r.kind}", "kwargs": r.kwargs}

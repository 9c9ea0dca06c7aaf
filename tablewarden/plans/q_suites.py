"""Queries of rule suites, SQL rules, rule discovery, stored results and consumer gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.operators import gate as G
from tablewarden.operators import results as S
from tablewarden.operators import rule_sets as D
from tablewarden.operators import rules as R
from tablewarden.operators import sql_rules as Q
from tablewarden.plans.q_rules import _row_sql
from tablewarden.plans.registry import query

# --- suites ----------------------------------------------------------------------------------------------
SUITE = [
    (R.rule("table_row_count_to_be_between", severity="P1", min_value=1), None),
    (R.rule("column_values_to_not_be_null", "l_orderkey", severity="P1"), ("count(*)", "l_orderkey IS NULL", 1.0)),
    (R.rule("column_values_to_not_be_null", "l_shipdate"), ("count(*)", "l_shipdate IS NULL", 1.0)),
    (R.rule("column_values_to_be_between", "l_quantity", severity="P1", min_value=1.0, max_value=50.0),
     ("count(l_quantity)", "l_quantity < 1 OR l_quantity > 50", 1.0)),
    (R.rule("column_values_to_be_between", "l_discount", min_value=0.0, max_value=0.05, mostly=0.5),
     ("count(l_discount)", "l_discount < 0 OR l_discount > 0.05", 0.5)),
    (R.rule("column_values_to_be_between", "l_tax", severity="P3", min_value=0.0, max_value=0.04),
     ("count(l_tax)", "l_tax < 0 OR l_tax > 0.04", 1.0)),
    (R.rule("column_values_to_be_in_set", "l_returnflag", severity="P1", value_set=["A", "N"]),
     ("count(l_returnflag)", "l_returnflag NOT IN ('A', 'N')", 1.0)),
    (R.rule("column_values_to_be_in_set", "l_linestatus", value_set=["O", "F"]),
     ("count(l_linestatus)", "l_linestatus NOT IN ('O', 'F')", 1.0)),
    (R.rule("column_value_lengths_to_equal", "l_returnflag", value=1),
     ("count(l_returnflag)", "length(l_returnflag) <> 1", 1.0)),
    (R.rule("column_values_to_match_regex", "l_linestatus", severity="P3", regex="^[OF]$"),
     ("count(l_linestatus)", "NOT regexp_matches(l_linestatus, '^[OF]$')", 1.0)),
    (R.rule("column_pair_values_a_to_be_greater_than_b", column_A="l_extendedprice", column_B="l_quantity"),
     ("count(*)", "NOT (l_extendedprice > l_quantity)", 1.0)),
    (R.rule("column_pair_values_to_be_in_set", column_A="l_returnflag", column_B="l_linestatus", severity="P3",
            value_pairs_set=[["N", "O"], ["A", "F"], ["R", "F"]], mostly=0.9),
     ("count(*)", "NOT ((l_returnflag = 'N' AND l_linestatus = 'O') OR (l_returnflag = 'A' AND l_linestatus = 'F')"
                  " OR (l_returnflag = 'R' AND l_linestatus = 'F'))", 0.9)),
]
RULES = [r for r, _ in SUITE]
COLS = ["expectation", "column_name", "severity", "success", "element_count", "unexpected_count"]


def _suite_sql(table: str = "lineitem") -> str:
    parts = [f"""SELECT '{RULES[0].kind}' AS expectation, '' AS column_name, 'P1' AS severity, count(*) >= 1 AS success,
                 CAST(NULL AS BIGINT) AS element_count, CAST(NULL AS BIGINT) AS unexpected_count FROM {table}"""]
    for r, spec in SUITE[1:]:
        n, bad, mostly = spec
        parts.append(f"""SELECT expectation, column_name, '{r.severity}' AS severity, success, element_count,
                         unexpected_count FROM ({_row_sql(r.kind, r.column or '', table, n, bad, mostly)})""")
    return " UNION ALL ".join(parts)


@query("x01_fused_suite", _suite_sql())
def _q(t):
    return R.validate(t.lineitem, RULES).select(*COLS)


@query("x02_failed_samples", """
  SELECT * FROM (
    SELECT 'tax' AS what, value, rank FROM (
      SELECT CAST(l_tax AS VARCHAR) AS value, row_number() OVER (ORDER BY CAST(l_tax AS VARCHAR)) AS rank
      FROM lineitem WHERE l_tax < 0 OR l_tax > 0.04) WHERE rank <= 5
    UNION ALL
    SELECT 'flag', value, rank FROM (
      SELECT l_returnflag AS value, row_number() OVER (ORDER BY l_returnflag) AS rank
      FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')) WHERE rank <= 5)""")
def _q(t):
    tax, flag = RULES[5], RULES[6]
    return R.samples(t.lineitem, RULES, [tax.rule_id, flag.rule_id]).select(
        F.when(F.col("rule_id") == tax.rule_id, "tax").otherwise("flag").alias("what"), "value", "rank")


@query("x03_isolated_rule", """
  SELECT * FROM (VALUES ('column_values_to_be_between', 'l_returnflag', false), ('no_such_rule', 'l_tax', false))
           v(expectation, column_name, success)
  UNION ALL SELECT 'column_values_to_not_be_null', 'l_tax', count(*) FILTER (WHERE l_tax IS NULL) = 0 FROM lineitem""")
def _q(t):
    return R.validate(t.lineitem, [
        R.rule("column_values_to_be_between", "l_returnflag", min_value={"bad": 1}),
        R.rule("no_such_rule", "l_tax"), R.rule("column_values_to_not_be_null", "l_tax")]) \
        .select("expectation", "column_name", "success")


@query("x04_missing_column", """
  SELECT 'gone' AS column_name, false AS success, 'missing column: gone' AS reason
  UNION ALL SELECT 'o_custkey', count(*) FILTER (WHERE o_custkey IS NULL) = 0, '' FROM orders""")
def _q(t):
    return R.validate(t.orders, [R.rule("column_values_to_not_be_null", "gone"),
                                 R.rule("column_values_to_not_be_null", "o_custkey")]) \
        .select("column_name", "success", "reason")


@query("x05_suite_summary", f"""
  SELECT count(*) AS evaluated, count(*) FILTER (WHERE success) AS passed, count(*) FILTER (WHERE NOT success) AS failed,
         round(100.0 * count(*) FILTER (WHERE success) / count(*), 6) AS success_percent,
         count(*) FILTER (WHERE NOT success AND severity = 'P1') AS p1_failed,
         count(*) FILTER (WHERE NOT success AND severity = 'P2') AS p2_failed,
         count(*) FILTER (WHERE NOT success AND severity = 'P3') AS p3_failed
  FROM ({_suite_sql()})""")
def _q(t):
    return R.summary(R.validate(t.lineitem, RULES)).withColumn("success_percent", F.round("success_percent", 6))


CONTRACT_DOCS = """
  to_json(named_struct('schema', array(named_struct('name', concat('t', p_partkey), 'properties', array(named_struct(
    'name', p_brand, 'quality', array(
      '{"rule":"missingCount","mustBe":0}',
      concat('{"rule":"duplicateCount","mustBeLessThan":', p_size, ',"unit":"percent"}'),
      concat('{"rule":"validValues","arguments":{"validValues":["', p_type, '"]},"mustBeGreaterOrEqualTo":95,"unit":"percent"}'),
      concat('{"implementation":{"expectation_type":"expect_column_max_to_be_between","kwargs":{"max_value":', p_size, '}}}')
    )))))))"""


@query("x07_contract_to_rules", """
  SELECT 't' || p_partkey AS table_name, p_brand AS column_name, e AS expectation,
         CASE e WHEN 'column_values_to_be_unique' THEN round(1 - p_size / 100.0, 4)
                WHEN 'column_values_to_be_in_set' THEN 0.95 END::DOUBLE AS mostly,
         CASE WHEN e = 'column_max_to_be_between' THEN p_size::VARCHAR END AS max_value
  FROM part, (VALUES ('column_values_to_not_be_null'), ('column_values_to_be_unique'), ('column_values_to_be_in_set'),
                     ('column_max_to_be_between')) v(e)""")
def _q(t):
    docs = t.part.selectExpr(f"{CONTRACT_DOCS} AS doc")
    return D.from_contract(docs).select(
        "table_name", "column_name", "expectation",
        F.get_json_object("kwargs", "$.mostly").cast("double").alias("mostly"),
        F.get_json_object("kwargs", "$.max_value").alias("max_value"))


def _part_rules(t):
    """Rule rows derived from parts: one range rule and one set rule per part."""
    return t.part.select(
        F.concat(F.lit("t"), (F.col("p_partkey") % 50).cast("string")).alias("table_name"),
        F.col("p_brand").alias("column_name"), F.col("p_partkey").alias("k"), F.inline(F.array(
            F.struct(F.lit("column_values_to_be_between").alias("expectation"),
                     F.format_string('{"min_value":%d,"max_value":%d}', F.col("p_size"), F.col("p_size") + 10).alias("kwargs")),
            F.struct(F.lit("column_values_to_not_be_null").alias("expectation"),
                     F.lit('{"mostly":0.9}').alias("kwargs"))))).withColumn("rule_id", D.rule_id())


PART_RULES = """
  (SELECT 't' || (p_partkey % 50) AS table_name, p_brand AS column_name, p_partkey AS k, p_size,
          'column_values_to_be_between' AS expectation,
          '{"min_value":' || p_size || ',"max_value":' || (p_size + 10) || '}' AS kwargs,
          left(sha256('column_values_to_be_between|' || p_brand || '|{"min_value":' || p_size || ',"max_value":'
               || (p_size + 10) || '}'), 12) AS rule_id FROM part
   UNION ALL
   SELECT 't' || (p_partkey % 50), p_brand, p_partkey, p_size, 'column_values_to_not_be_null', '{"mostly":0.9}',
          left(sha256('column_values_to_not_be_null|' || p_brand || '|{"mostly":0.9}'), 12) FROM part)"""


@query("x07_rules_to_contract", f"""
  SELECT rule_id, CASE expectation WHEN 'column_values_to_not_be_null'
           THEN '{{"rule":"missingCount","mustBeLessThan":10.0,"unit":"percent"}}'
           ELSE '{{"engine":"greatExpectations","implementation":{{"expectation_type":"expect_' || expectation
                || '","kwargs":' || kwargs || '}}}}' END AS definition
  FROM {PART_RULES}""")
def _q(t):
    return D.to_contract(_part_rules(t)).select("rule_id", "definition")


@query("x08_rule_decisions", f"""
  SELECT table_name, column_name, expectation, rule_id FROM {PART_RULES}
  WHERE rule_id NOT IN (SELECT rule_id FROM {PART_RULES} WHERE p_size % 7 = 0 AND expectation LIKE '%between')
  UNION ALL SELECT 't0', p_type, 'manual', 'm' || p_partkey FROM part WHERE p_size = 1""")
def _q(t):
    rows = _part_rules(t)
    size = F.get_json_object("kwargs", "$.min_value").cast("int")
    manual = t.part.where("p_size = 1").select(
        F.lit("t0").alias("table_name"), F.col("p_type").alias("column_name"), F.lit("manual").alias("expectation"),
        F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("rule_id"))
    return D.apply_decisions(rows, rows.where(size % 7 == 0), manual) \
        .select("table_name", "column_name", "expectation", "rule_id")


@query("x09_many_tables", """
  SELECT 'customer' AS table_name, CASE WHEN bool_and(c_acctbal >= 0) THEN 'passed' ELSE 'failed' END AS status,
         CAST(1 AS BIGINT) AS rules FROM customer
  UNION ALL SELECT 'orders', CASE WHEN bool_and(o_orderstatus IN ('O', 'F', 'P')) THEN 'passed' ELSE 'failed' END, 2 FROM orders""")
def _q(t):
    return R.table_outcomes(R.validate_many(
        {"customer": t.customer, "orders": t.orders, "skipped": t.part},
        {"customer": [R.rule("column_values_to_be_between", "c_acctbal", min_value=0.0)],
         "orders": [R.rule("column_values_to_be_in_set", "o_orderstatus", value_set=["O", "F", "P"]),
                    R.rule("column_values_to_not_be_null", "o_orderkey")]}))


@query("x10_rules_from_detection", """
  SELECT 'customer' AS table_name, c_name AS column_name, 'column_values_to_match_regex' AS expectation,
         '^x' || (c_custkey % 3) AS regex FROM customer WHERE c_acctbal > 0""")
def _q(t):
    ev = t.customer.select(F.lit("customer").alias("table_name"), F.col("c_name").alias("column"),
                           (F.col("c_acctbal") > 0).alias("detected"),
                           F.concat(F.lit("p"), (F.col("c_custkey") % 3).cast("string")).alias("pattern_name"))
    patterns = t.region.select(F.concat(F.lit("p"), F.col("r_regionkey").cast("string")).alias("pattern_name"),
                               F.concat(F.lit("^x"), F.col("r_regionkey").cast("string")).alias("regex"))
    return D.from_pii(ev, patterns).select("table_name", "column_name", "expectation",
                                           F.get_json_object("kwargs", "$.regex").alias("regex"))


# --- SQL rules -------------------------------------------------------------------------------------------

@query("q01_sql_rows", """
  SELECT 'negative' AS rule_name, n < 1 AS success, CAST(n AS DOUBLE) AS observed_value, n AS unexpected_count,
         least(n, 5) AS n_samples FROM (SELECT count(*) AS n FROM customer WHERE c_acctbal < 0)""")
def _q(t):
    return Q.evaluate(t.customer, Q.sql_rule("SELECT c_custkey, c_acctbal FROM ${object} WHERE c_acctbal < 0", "negative")) \
        .select("rule_name", "success", "observed_value", "unexpected_count", F.size("samples").cast("bigint").alias("n_samples"))


@query("q02_sql_value", """
  SELECT 'big orders' AS rule_name, n BETWEEN 10 AND 100000000 AS success, CAST(n AS DOUBLE) AS observed_value,
         CAST(0 AS BIGINT) AS unexpected_count FROM (SELECT count(*) AS n FROM orders WHERE o_totalprice > 300000)
  UNION ALL SELECT 'mean', avg(o_totalprice) > 1e9, round(avg(o_totalprice), 4), 0 FROM orders""")
def _q(t):
    return Q.evaluate_all(t.orders, [
        Q.sql_rule("SELECT COUNT(*) FROM data WHERE o_totalprice > 300000", "big orders", mustBeBetween=[10, 100000000]),
        Q.sql_rule("SELECT avg(o_totalprice) FROM data", "mean", mustBeGreaterThan=1e9)]) \
        .select("rule_name", "success", F.round("observed_value", 4).alias("observed_value"), "unexpected_count")


@query("q03_sql_placeholders", """
  SELECT count(*) < 1 AS success, CAST(count(*) AS DOUBLE) AS observed_value FROM part WHERE p_size > 45
  UNION ALL SELECT count(*) < 1, CAST(count(*) AS DOUBLE) FROM part WHERE p_size IS NULL""")
def _q(t):
    return Q.evaluate_all(t.part, [
        Q.sql_rule("WITH big AS (SELECT * FROM shop.parts WHERE ${property} > 45) SELECT * FROM big;", column="p_size"),
        Q.sql_rule("SELECT * FROM `shop`.`parts` WHERE ${property} IS NULL -- nothing; here", column="p_size")],
        "shop.parts").select("success", "observed_value")


@query("q05_sql_thresholds", """
  SELECT o_orderkey, o_totalprice = 100 AS be, o_totalprice <> 100 AS not_be, o_totalprice > 100000 AS gt,
         o_totalprice <= 200000 AS le, o_totalprice BETWEEN 1000 AND 250000 AS bt, NOT (o_totalprice BETWEEN 1000 AND 250000) AS nbt,
         false AS null_passes FROM orders""")
def _q(t):
    v = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", Q.passes(v, {"mustBe": 100}).alias("be"), Q.passes(v, {"mustNotBe": 100}).alias("not_be"),
        Q.passes(v, {"mustBeGreaterThan": 100000}).alias("gt"), Q.passes(v, {"mustBeLessOrEqualTo": 200000}).alias("le"),
        Q.passes(v, {"mustBeBetween": [1000, 250000]}).alias("bt"),
        Q.passes(v, {"mustNotBeBetween": [1000, 250000]}).alias("nbt"),
        Q.passes(F.lit(None).cast("double"), {"mustBeLessThan": 1}).alias("null_passes"))


@query("q06_sql_isolated_failure", """
  SELECT 'broken' AS rule_name, false AS success UNION ALL SELECT 'two', false
  UNION ALL SELECT 'fine', count(*) FILTER (WHERE o_orderkey IS NULL) < 1 FROM orders""")
def _q(t):
    return Q.evaluate_all(t.orders, [
        Q.sql_rule("SELECT nothing_here FROM data", "broken"), Q.sql_rule("SELECT 1; SELECT 2", "two"),
        Q.sql_rule("SELECT * FROM data WHERE o_orderkey IS NULL", "fine")]).select("rule_name", "success")


# --- discovery -------------------------------------------------------------------------------------------

@query("d01_suggest_rules", """
  WITH p AS (
    SELECT 'o_orderkey' AS c, count(*) AS n, count(*) - count(o_orderkey) AS z, count(DISTINCT o_orderkey) AS d,
           min(o_orderkey)::DOUBLE AS lo, max(o_orderkey)::DOUBLE AS hi FROM orders
    UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), NULL, NULL FROM orders
    UNION ALL SELECT 'o_totalprice', count(*), count(*) - count(o_totalprice), count(DISTINCT o_totalprice), min(o_totalprice), max(o_totalprice) FROM orders)
  SELECT c AS column_name, 'column_values_to_not_be_null' AS expectation FROM p WHERE z::DOUBLE / n < 0.05
  UNION ALL SELECT c, 'column_values_to_be_unique' FROM p WHERE round(d::DOUBLE / n, 6) >= 0.98
  UNION ALL SELECT c, 'column_values_to_be_between' FROM p WHERE lo <= hi
  UNION ALL SELECT c, 'column_values_to_be_in_set' FROM p WHERE d BETWEEN 2 AND 10""")
def _q(t):
    from tablewarden.operators import profile as P
    df = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    top = P.top_values(df, k=10).groupBy("column").agg(F.collect_list("value").alias("frequent"))
    prof = P.metrics(df).join(top, "column").withColumnRenamed("row_count", "rows")
    return D.suggest(prof).select("column_name", "expectation")


@query("d02_cover_columns", """
  WITH p AS (
    SELECT 'c_custkey' AS c, count(*) AS n, count(*) - count(c_custkey) AS z, count(DISTINCT c_custkey) AS d, NULL::BIGINT AS lo, NULL::BIGINT AS hi FROM customer
    UNION ALL SELECT 'c_name', count(*), count(*) - count(c_name), count(DISTINCT c_name), min(length(c_name)), max(length(c_name)) FROM customer
    UNION ALL SELECT 'c_mktsegment', count(*), count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment), min(length(c_mktsegment)), max(length(c_mktsegment)) FROM customer)
  SELECT c AS column_name, 'missingCount' AS rule, '{"mustBe":0}' AS definition FROM p WHERE z = 0
  UNION ALL SELECT c, 'duplicateCount', '{"mustBe":0}' FROM p WHERE z = 0 AND d = n
  UNION ALL SELECT c, 'column_value_lengths_to_be_between', '{"min_value":' || lo || ',"max_value":' || hi || '}' FROM p WHERE lo IS NOT NULL""")
def _q(t):
    return D.cover(t.customer, covered=["c_nationkey", "c_acctbal"])


@query("d03_relax_rules", f"""
  SELECT k, greatest(0.0, floor(p_size - 1.0))::DOUBLE AS relaxed_min, ceil(p_size + 10 + 1.0)::DOUBLE AS relaxed_max
  FROM {PART_RULES} WHERE expectation LIKE '%between'""")
def _q(t):
    return D.relax(_part_rules(t), 0.1).where("relaxed_min is not null").select("k", "relaxed_min", "relaxed_max")


@query("d03_relax_quantiles", """
  SELECT p_partkey AS k, greatest(0.0, floor((p_size - 1.0) / 1.0 + 1e-9))::DOUBLE AS low, ceil((p_size + 10 + 1.0) / 1.0 - 1e-9)::DOUBLE AS high, true AS opened,
         greatest(0, p_size - 1)::BIGINT AS must_low, (p_size + 11)::BIGINT AS must_high FROM part""")
def _q(t):
    size = F.col("p_size")
    ranges = F.to_json(F.struct(F.struct(F.array(F.lit(0.5), F.lit(0.9)).alias("quantiles"), F.array(F.array(size, size + 10), F.array(F.lit(None), size)).alias("value_ranges")).alias("quantile_ranges"),
                                F.lit("keep").alias("note")), {"ignoreNullFields": "false"})
    must = F.to_json(F.struct(F.array(size, size + 10).alias("mustBeBetween"), F.lit("keep").alias("note")))
    key = F.col("p_partkey").alias("k")
    rows = t.part.select(key, F.lit("column_quantile_values_to_be_between").alias("expectation"), ranges.alias("kwargs")) \
        .unionByName(t.part.select(key, F.lit("invalidCount").alias("expectation"), must.alias("kwargs")))
    out = D.relax(rows, 0.1)
    got = lambda path: F.get_json_object("kwargs", path)
    value = lambda path, kind: F.max(got(path).cast(kind))
    opened = F.every(F.when(F.col("expectation").contains("quantile"), got("$.quantile_ranges.value_ranges[1]").startswith("[null,")).otherwise(True) & (got("$.note") == "keep"))
    return out.groupBy("k").agg(value("$.quantile_ranges.value_ranges[0][0]", "double").alias("low"), value("$.quantile_ranges.value_ranges[0][1]", "double").alias("high"),
                                opened.alias("opened"), value("$.mustBeBetween[0]", "bigint").alias("must_low"), value("$.mustBeBetween[1]", "bigint").alias("must_high"))


@query("d04_drop_rules", f"""
  SELECT table_name, column_name, expectation, count(*) AS n FROM {PART_RULES}
  WHERE column_name <> 'Brand#2' AND expectation NOT LIKE '%null' GROUP BY ALL""")
def _q(t):
    kept = D.drop(_part_rules(t), columns=["Brand#2"], types=["column_values_to_not_be_null"], snapshot=True)
    return kept.groupBy("table_name", "column_name", "expectation").agg(F.count(F.lit(1)).alias("n"))


@query("d05_diff_rules", f"""
  WITH o AS (SELECT DISTINCT table_name, column_name, rule_id, expectation FROM {PART_RULES} WHERE k % 3 <> 0),
       n AS (SELECT DISTINCT table_name, column_name, rule_id, expectation FROM {PART_RULES} WHERE k % 4 <> 0),
       pii AS (SELECT DISTINCT table_name, column_name FROM {PART_RULES} WHERE k % 5 = 0)
  SELECT change, count(*) AS n FROM (
    SELECT CASE WHEN n.rule_id IS NOT NULL AND pii.table_name IS NOT NULL AND n.expectation LIKE '%between' THEN 'withheld'
                WHEN n.rule_id IS NOT NULL AND o.rule_id IS NOT NULL THEN 'kept' WHEN n.rule_id IS NOT NULL THEN 'added' ELSE 'removed' END AS change
    FROM (SELECT * FROM o SEMI JOIN n USING (table_name, column_name)) o
    FULL JOIN n USING (table_name, column_name, rule_id)
    LEFT JOIN pii USING (table_name, column_name)) GROUP BY change""")
def _q(t):
    rows = _part_rules(t)
    keys = ["table_name", "column_name", "rule_id", "expectation"]
    old = rows.where("k % 3 <> 0").select(*keys).distinct()
    new = rows.where("k % 4 <> 0").select(*keys).distinct()
    return D.diff(old, new, rows.where("k % 5 = 0")).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("d06_merge_drafts", f"""
  SELECT table_name, column_name, expectation, arg_max(kwargs, (k, kwargs)) AS kwargs, max(k) AS k
  FROM {PART_RULES} GROUP BY table_name, column_name, expectation""")
def _q(t):
    return D.merge(_part_rules(t), ["table_name", "column_name", "expectation"], "k") \
        .select("table_name", "column_name", "expectation", "kwargs", "k")


@query("d07_rule_ids_and_digest", f"""
  SELECT table_name, sha256(array_to_string(list_sort(list(DISTINCT rule_id)), ',')) AS rule_set_digest
  FROM {PART_RULES} GROUP BY table_name""")
def _q(t):
    return D.digest(_part_rules(t))


@query("v10_strip_value_bearing", f"""
  SELECT rule_id, k FROM {PART_RULES}
  WHERE expectation NOT LIKE '%between' OR (table_name, column_name) NOT IN
        (SELECT (table_name, column_name) FROM {PART_RULES} WHERE k % 11 = 0)""")
def _q(t):
    rows = _part_rules(t)
    return D.strip_value_bearing(rows, rows.where("k % 11 = 0")).select("rule_id", "k")


# --- stored results and gates -----------------------------------------------------------------------------
EVENT_RULES = [
    R.rule("column_values_to_be_between", "value", severity="P1", min_value=0.0, max_value=115.0, mostly=0.9),
    R.rule("column_values_to_not_be_null", "user_id", severity="P1"),
    R.rule("column_values_to_be_in_set", "event_type", value_set=["click", "view", "purchase", "signup"], mostly=0.8),
]


def _daily(t):
    return t.events.withColumn("dt", F.to_date("ts"))


def _store(t):
    """Two validation runs per day: an early one over half the events, a later one over all of them."""
    df = _daily(t)
    digest = "d1"
    early = S.record(df.where("event_id % 2 = 0"), "shop.events", ["dt"], EVENT_RULES, digest, F.lit("2024-02-01 06:00:00"))
    late = S.record(df, "shop.events", ["dt"], EVENT_RULES, digest, F.lit("2024-02-01 18:00:00"))
    return early[0].unionByName(late[0]), early[1].unionByName(late[1])


def _rule_set(t):
    """The rule set the runs used, as stored rows."""
    base = t.region.where("r_regionkey = 0")     # one row to hang the declared rules on
    rows = [F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.kind).alias("rule_type"), F.lit(r.kind).alias("expectation"),
                     F.lit(r.column).alias("column_name"), F.lit(r.severity).alias("severity"),
                     F.lit("team-a").alias("owner")) for r in EVENT_RULES]
    return base.select(F.lit("shop.events").alias("table_name"), F.lit("d1").alias("rule_set_digest"),
                       F.inline(F.array(*rows)), ).withColumn("description", F.lit("")) \
        .withColumn("created_at", F.lit("2024-02-01 00:00:00").cast("timestamp"))


DAILY = """
  (SELECT CAST(ts AS DATE) AS dt, {half} AS half, count(*) AS n,
          count(*) FILTER (WHERE value < 0 OR value > 115) AS bad_value, count(*) FILTER (WHERE user_id IS NULL) AS bad_user,
          count(*) FILTER (WHERE event_type NOT IN ('click','view','purchase','signup')) AS bad_type
   FROM events WHERE {cond} GROUP BY 1)"""
FULL = DAILY.format(half="'late'", cond="true")
HALF = DAILY.format(half="'early'", cond="event_id % 2 = 0")
CHECKS = """
  (SELECT dt, half, n, 'value' AS column_name, 'P1' AS severity, bad_value AS bad, 1.0 - bad_value::DOUBLE / n >= 0.9 - 1e-12 AS ok FROM {src}
   UNION ALL SELECT dt, half, n, 'user_id', 'P1', bad_user, bad_user = 0 FROM {src}
   UNION ALL SELECT dt, half, n, 'event_type', 'P2', bad_type, 1.0 - bad_type::DOUBLE / n >= 0.8 - 1e-12 FROM {src})"""
FULL_CHECKS, HALF_CHECKS = CHECKS.format(src=FULL), CHECKS.format(src=HALF)


@query("g01_validate_partition_runs", f"""
  SELECT 'dt=' || dt AS partition, n AS row_count, CAST(count(*) AS INTEGER) AS rules_total,
         CAST(count(*) FILTER (WHERE ok) AS INTEGER) AS rules_passed,
         CAST(count(*) FILTER (WHERE NOT ok AND severity = 'P1') AS INTEGER) AS p1_failed,
         CASE WHEN bool_and(ok) THEN 'passed' ELSE 'failed' END AS status
  FROM {FULL_CHECKS} GROUP BY dt, n HAVING dt >= DATE '2024-01-08'""")
def _q(t):
    df = _daily(t)
    _, runs = S.record(df, "shop.events", ["dt"], EVENT_RULES, "d1", F.lit("2024-02-01 18:00:00"))
    _, stored = S.record(df.where("dt < '2024-01-08'"), "shop.events", ["dt"], EVENT_RULES, "d1", F.lit("2024-02-01 06:00:00"))
    return S.only_new(runs, stored).select("partition", "row_count", "rules_total", "rules_passed", "p1_failed", "status")


@query("g02_partition_spec", """
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'dt,hour' WHEN o_orderkey % 3 = 1 THEN 'day' ELSE '' END AS partition_column,
         CAST(o_orderdate AS DATE) AS partition_date,
         strftime(CAST(o_orderdate AS DATE)::TIMESTAMP + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 5 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H') AS partition_ts
  FROM orders""")
def _q(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    p = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("dt="), day, F.lit("/hour=05"))) \
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("day="), F.date_format("o_orderdate", "yyyyMMdd"))).otherwise(day)
    return t.orders.select("o_orderkey", S.partition_spec(p).alias("s")) \
        .select("o_orderkey", "s.partition_column", "s.partition_date", F.date_format("s.partition_ts", "yyyy-MM-dd HH").alias("partition_ts"))


@query("g03_validate_all_partitions", f"""
  SELECT dt, column_name, ok AS success, n AS element_count, bad AS unexpected_count FROM {FULL_CHECKS}""")
def _q(t):
    return R.validate_by(_daily(t), ["dt"], EVENT_RULES) \
        .select("dt", "column_name", "success", "element_count", "unexpected_count")


@query("g03_validate_lineitem_by_month", """
  SELECT month, n = d AS unique_ok, round(med, 4) AS median FROM (
    SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS d,
           quantile_cont(l_extendedprice, 0.5) AS med FROM lineitem GROUP BY 1)""")
def _q(t):
    df = t.lineitem.withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    out = R.validate_by(df, ["month"], [
        R.rule("compound_columns_to_be_unique", column_list=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]),
        R.rule("column_median_to_be_between", "l_extendedprice", min_value=0)])
    return out.groupBy("month").agg(
        F.every(F.when(F.col("expectation") == "compound_columns_to_be_unique", F.col("success"))).alias("unique_ok"),
        F.round(F.max("observed_value"), 4).alias("median"))


@query("g04_latest_runs", f"""
  SELECT 'dt=' || dt AS partition, n AS row_count, '2024-02-01 18:00' AS validated_at FROM {FULL}""")
def _q(t):
    return S.latest_runs(_store(t)[1]).select("partition", "row_count", F.date_format("validated_at", "yyyy-MM-dd HH:mm").alias("validated_at"))


@query("g05_latest_results", f"""
  SELECT 'dt=' || dt AS partition, column_name, ok AS passed, bad AS unexpected_count
  FROM {FULL_CHECKS} WHERE dt = (SELECT max(CAST(ts AS DATE)) FROM events)""")
def _q(t):
    results, runs = _store(t)
    return S.latest(runs, results).select("partition", "column_name", "passed", "unexpected_count")


@query("g06_results_of_runs", f"""
  SELECT 'dt=' || dt AS partition, column_name, ok AS passed FROM {FULL_CHECKS} WHERE column_name IN ('value', 'user_id')""")
def _q(t):
    results, runs = _store(t)
    return S.results_of(results, S.latest_runs(runs), [r.rule_id for r in EVENT_RULES[:2]]) \
        .select("partition", "column_name", "passed")


def _sets(t):
    """Rule sets of many digests: one per (brand, size class) of parts."""
    return t.part.select(
        F.col("p_type").alias("table_name"), F.concat(F.lit("d"), (F.col("p_partkey") % 20).cast("string")).alias("rule_set_digest"),
        F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("rule_id"), F.lit("row").alias("rule_type"),
        F.when(F.col("p_size") > 25, "column_values_to_be_between").otherwise("column_values_to_not_be_null").alias("expectation"),
        F.col("p_brand").alias("column_name"), F.concat(F.lit("P"), (F.col("p_partkey") % 3 + 1).cast("string")).alias("severity"),
        F.concat(F.lit("team-"), (F.col("p_size") % 4).cast("string")).alias("owner"), F.col("p_name").alias("description"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("p_partkey") % 20).cast("int"))).alias("created_at"))


@query("g06_newest_rule_set", """
  SELECT p_type AS table_name, 'd' || (p_partkey % 20) AS rule_set_digest, 'r' || p_partkey AS rule_id
  FROM part JOIN (SELECT p_type, max(p_partkey % 20) AS m FROM part GROUP BY 1) USING (p_type) WHERE p_partkey % 20 = m""")
def _q(t):
    return S.newest_rule_set(_sets(t)).select("table_name", "rule_set_digest", "rule_id")


@query("g07_new_rule_sets", """
  SELECT p_type AS table_name, 'd' || (p_partkey % 20) AS rule_set_digest, 'r' || p_partkey AS rule_id
  FROM part WHERE p_partkey % 20 >= 12""")
def _q(t):
    s = _sets(t)
    return S.new_rule_sets(s, s.where("cast(substring(rule_set_digest, 2) as int) < 12")) \
        .select("table_name", "rule_set_digest", "rule_id")


@query("g08_select_rules", """
  SELECT 'r' || p_partkey AS rule_id FROM part
  WHERE p_partkey IN (7, 11) OR (p_partkey % 3 + 1 = 1 AND p_size > 25 AND p_size % 4 = 2)""")
def _q(t):
    sel = G.Selection(ids=["r7", "r11"], types=["column_values_to_be_between"], severities=["P1"], owners=["team-2"])
    return G.select_rules(_sets(t), sel).select("rule_id")


@query("g09_window_latest", """
  SELECT 'dt=' || dt AS partition FROM (SELECT DISTINCT CAST(ts AS DATE) AS dt FROM events ORDER BY 1 DESC LIMIT 4)""")
def _q(t):
    return G.Window(latest=4).expected(_store(t)[1], "2024-01-31")


VERDICT_SQL = f"""
  SELECT CAST(d AS DATE) AS partition_date, CASE WHEN c.dt IS NULL THEN 'missing' WHEN c.bad > 0 THEN 'failed' ELSE 'passed' END AS status,
         coalesce(c.bad, 0) AS rules_failed
  FROM (SELECT unnest(generate_series(DATE '2024-01-20', DATE '2024-02-02', INTERVAL 1 DAY)) AS d)
  LEFT JOIN (SELECT dt, count(*) FILTER (WHERE NOT ok) AS bad FROM {FULL_CHECKS} WHERE severity = 'P1' GROUP BY dt) c ON c.dt = CAST(d AS DATE)"""


def _verdicts(t, **kw):
    results, runs = _store(t)
    return G.verdicts(runs, results, _rule_set(t), G.Window(since="2024-01-20"), G.Selection(severities=["P1"]), "2024-02-02")


@query("g10_partition_verdicts", VERDICT_SQL)
def _q(t):
    return _verdicts(t).select("partition_date", "status", "rules_failed")


@query("g10_incomplete_rules", f"""
  SELECT 'dt=' || dt AS partition, CASE WHEN bad > 0 THEN 'failed' ELSE 'incomplete' END AS status FROM (
    SELECT dt, count(*) FILTER (WHERE NOT ok AND column_name = 'value') AS bad FROM {FULL_CHECKS} GROUP BY dt ORDER BY dt DESC LIMIT 3)""")
def _q(t):
    results, runs = _store(t)
    sel = G.Selection(ids=[EVENT_RULES[0].rule_id, "unknown"])
    return G.verdicts(runs, results, _rule_set(t), G.Window(latest=3), sel, "2024-02-02").select("partition", "status")


@query("g11_decision", f"""
  WITH v AS ({VERDICT_SQL}), k AS (SELECT * FROM v WHERE status <> 'missing')
  SELECT 'all' AS require, (SELECT bool_and(status = 'passed') FROM v) AS accepted, (SELECT count(*) FROM v) AS considered
  UNION ALL SELECT 'any', (SELECT bool_or(status = 'passed') FROM k), (SELECT count(*) FROM k)
  UNION ALL SELECT 'latest', (SELECT arg_max(status, partition_date) = 'passed' FROM k), (SELECT count(*) FROM k)""")
def _q(t):
    v = _verdicts(t)
    out = None
    for req, miss in (("all", "block"), ("any", "ignore"), ("latest", "ignore")):
        d = G.decide(v, req, miss).select(F.lit(req).alias("require"), "accepted", "considered")
        out = d if out is None else out.unionByName(d)
    return out


@query("g12_accepted_partitions", f"""
  SELECT dt, n FROM {FULL} WHERE dt IN (SELECT partition_date FROM ({VERDICT_SQL}) WHERE status = 'passed')""")
def _q(t):
    return G.accepted_rows(_daily(t), _verdicts(t), "dt").groupBy("dt").agg(F.count(F.lit(1)).alias("n"))


@query("g13_consumer_rules", """
  SELECT 'producer' AS owner, n < 1 AS success FROM (SELECT count(*) AS n FROM events WHERE value < 0)
  UNION ALL SELECT 'billing', n < 100 FROM (SELECT count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 100)""")
def _q(t):
    rules = G.with_consumer_rules(
        [Q.sql_rule("SELECT * FROM data WHERE value < 0", "no negatives", owner="producer")],
        {"billing": [Q.sql_rule("SELECT * FROM data WHERE event_type = 'purchase' AND value > 100", "large", mustBeLessThan=100)]})
    return Q.evaluate_all(t.events, rules).select(
        F.when(F.col("rule_name") == "large", "billing").otherwise("producer").alias("owner"), "success")


@query("g14_fingerprint", "SELECT CAST(ts AS DATE) AS dt, count(*) AS row_count FROM events GROUP BY 1")
def _q(t):
    a = S.fingerprint(_daily(t), ["dt"])
    b = S.fingerprint(_daily(t).repartition(5, "user_id"), ["dt"])     # another row order, the same content
    return a.join(b, ["dt", "data_fingerprint", "row_count"]).select("dt", "row_count")


@query("g15_rule_catalog", """
  SELECT 'r' || p_partkey AS rule_id, p_brand AS column_name, 'team-' || (p_size % 4) AS owner
  FROM part JOIN (SELECT p_type, max(p_partkey % 20) AS m FROM part GROUP BY 1) USING (p_type) WHERE p_partkey % 20 = m""")
def _q(t):
    return S.rule_catalog(_sets(t)).select("rule_id", "column_name", "owner")


@query("s20_read_results", f"""
  SELECT 'dt=' || dt AS partition, column_name, ok AS passed FROM {FULL_CHECKS}
  WHERE dt BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' AND NOT ok""")
def _q(t):
    results, _ = S.record(_daily(t), "shop.events", ["dt"], EVENT_RULES, "d1", F.lit("2024-02-01 18:00:00"))
    return S.read_filter(results, {"passed": False}, {"table_name": ["shop.events"]}, "2024-01-05", "2024-01-12") \
        .select("partition", "column_name", "passed")

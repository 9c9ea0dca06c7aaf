"""Queries of the quality rules, the rule suite, SQL rules and rule discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.operators import rules as R
from tablewarden.plans.registry import query


def _view(df):
    """The columns of a rule result that do not depend on how an engine prints values."""
    return df.select("expectation", "column_name", "success", "element_count", "unexpected_count",
                     F.round("unexpected_pct", 6).alias("unexpected_pct"))


def _stat(df):
    return df.select("expectation", "column_name", "success", F.round("observed_value", 4).alias("observed_value"))


def _row_sql(kind: str, column: str, table: str, n: str, bad: str, mostly: float = 1.0) -> str:
    return f"""
      SELECT '{kind}' AS expectation, '{column}' AS column_name,
             (n = 0 OR 1.0 - bad::DOUBLE / n >= {mostly} - 1e-12) AS success,
             n AS element_count, bad AS unexpected_count,
             CASE WHEN n = 0 THEN 0.0 ELSE round(100.0 * bad / n, 6) END AS unexpected_pct
      FROM (SELECT CAST({n} AS BIGINT) AS n,
                   CAST(coalesce(sum(CASE WHEN {bad} THEN 1 ELSE 0 END), 0) AS BIGINT) AS bad FROM {table})"""


def _row(name: str, table: str, kind: str, column: str | None, bad: str, n: str | None = None, **kw):
    """A per-row rule and its SQL."""
    sql = _row_sql(kind, column or "", table, n or (f"count({column})" if column else "count(*)"), bad,
                   kw.get("mostly") or 1.0)

    @query(name, sql)
    def _q(t):
        return _view(R.validate(getattr(t, table), [R.rule(kind, column, **kw)]))


def _value(name: str, table: str, kind: str, column: str | None, expr: str, lo, hi, **kw):
    """A statistic that must fall in a range."""
    low = f"v >= {lo}" if lo is not None else "true"
    high = f"v <= {hi}" if hi is not None else "true"
    sql = f"""SELECT '{kind}' AS expectation, '{column or ''}' AS column_name,
                     coalesce({low} AND {high}, false) AS success, round(v, 4) AS observed_value
              FROM (SELECT CAST({expr} AS DOUBLE) AS v FROM {table})"""
    args = dict(kw)
    if "value" not in args:
        args |= {"min_value": lo, "max_value": hi}

    @query(name, sql)
    def _q(t):
        return _stat(R.validate(getattr(t, table), [R.rule(kind, column, **args)]))


def _schema(name: str, table: str, kind: str, column: str | None, sql_ok: str, **kw):
    sql = f"""SELECT '{kind}' AS expectation, '{column or ''}' AS column_name, ({sql_ok}) AS success
              FROM (SELECT list(column_name ORDER BY cid) AS names, list(column_type ORDER BY cid) AS types
                    FROM (SELECT column_name, column_type, row_number() OVER () AS cid
                          FROM (DESCRIBE {table})))"""

    @query(name, sql)
    def _q(t):
        return R.validate(getattr(t, table), [R.rule(kind, column, **kw)]) \
            .select("expectation", "column_name", "success")


LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
NATION = ["n_nationkey", "n_name", "n_regionkey"]


def _names(cols):
    return "[" + ", ".join(f"'{c}'" for c in cols) + "]"


# --- table shape -----------------------------------------------------------------------------------------
_schema("r01_column_exists", "lineitem", "column_to_exist", "l_tax", "list_contains(names, 'l_tax')")
_schema("r02_columns_match_set", "lineitem", "table_columns_to_match_set", None,
        f"list_sort(names) = list_sort({_names(LINEITEM)})", column_set=list(reversed(LINEITEM)))
_schema("r03_columns_match_ordered_list", "nation", "table_columns_to_match_ordered_list", None,
        f"names = {_names(NATION)}", column_list=NATION)
_schema("r04_column_count_equals", "orders", "table_column_count_to_equal", None, "len(names) = 6", value=6)
_schema("r05_column_count_between", "orders", "table_column_count_to_be_between", None,
        "len(names) BETWEEN 7 AND 9", min_value=7, max_value=9)
_schema("r06_column_of_type", "orders", "column_values_to_be_of_type", "o_orderkey",
        "types[list_position(names, 'o_orderkey')] = 'BIGINT'", type_="LongType")
_schema("r07_column_in_type_list", "customer", "column_values_to_be_in_type_list", "c_name",
        "types[list_position(names, 'c_name')] IN ('BIGINT', 'INTEGER', 'VARCHAR')", type_list=["bigint", "int", "string"])

# --- counts ----------------------------------------------------------------------------------------------
_value("r08_row_count_between", "lineitem", "table_row_count_to_be_between", None, "count(*)", 1, 10000000)
_value("r09_row_count_equals", "nation", "table_row_count_to_equal", None, "count(*)", 25, 25, value=25)

# --- row rules -------------------------------------------------------------------------------------------
_row("r10_not_null", "labels", "column_values_to_not_be_null", "toxic", "toxic IS NULL", "count(*)")
_row("r11_be_null", "labels", "column_values_to_be_null", "toxic", "toxic IS NOT NULL", "count(*)", mostly=0.1)
_row("r12_in_set", "lineitem", "column_values_to_be_in_set", "l_returnflag",
     "l_returnflag NOT IN ('A', 'N')", value_set=["A", "N"], mostly=0.6)
_row("r13_not_in_set", "orders", "column_values_to_not_be_in_set", "o_orderstatus",
     "o_orderstatus IN ('P')", value_set=["P"])
_row("r14_values_between", "lineitem", "column_values_to_be_between", "l_quantity",
     "l_quantity <= 1 OR l_quantity > 48", min_value=1.0, max_value=48.0, strict_min=True, mostly=0.9)
_row("r15_lengths_between", "customer", "column_value_lengths_to_be_between", "c_mktsegment",
     "length(c_mktsegment) < 8 OR length(c_mktsegment) > 9", min_value=8, max_value=9)
_row("r16_lengths_equal", "orders", "column_value_lengths_to_equal", "o_orderstatus", "length(o_orderstatus) <> 1",
     value=1)
_row("r17_match_regex", "part", "column_values_to_match_regex", "p_brand",
     "NOT regexp_matches(p_brand, '^Brand#[1-3][1-5]$')", regex="^Brand#[1-3][1-5]$", mostly=0.5)
_row("r18_not_match_regex", "documents", "column_values_to_not_match_regex", "text",
     "regexp_matches(text, '[0-9]{4}')", regex="[0-9]{4}")
_row("r19_match_regex_list", "orders", "column_values_to_match_regex_list", "o_orderpriority",
     "NOT (regexp_matches(o_orderpriority, '^1') OR regexp_matches(o_orderpriority, 'LOW'))",
     regex_list=["^1", "LOW"], mostly=0.3)
_row("r20_not_match_regex_list", "orders", "column_values_to_not_match_regex_list", "o_orderpriority",
     "(regexp_matches(o_orderpriority, '^1') OR regexp_matches(o_orderpriority, 'LOW'))", regex_list=["^1", "LOW"])
_row("r23_unique_within_record", "lineitem", "select_column_values_to_be_unique_within_record", None,
     "l_partkey = l_suppkey OR l_partkey = l_linenumber OR l_suppkey = l_linenumber",
     column_list=["l_partkey", "l_suppkey", "l_linenumber"])
_row("r24_pair_equal", "lineitem", "column_pair_values_to_be_equal", None, "l_discount <> l_tax",
     column_A="l_discount", column_B="l_tax", mostly=0.1)
_row("r25_pair_greater", "lineitem", "column_pair_values_a_to_be_greater_than_b", None,
     "NOT (l_extendedprice >= l_quantity)", column_A="l_extendedprice", column_B="l_quantity", or_equal=True)
_row("r26_pair_in_set", "lineitem", "column_pair_values_to_be_in_set", None,
     "NOT ((l_returnflag = 'N' AND l_linestatus = 'O') OR (l_returnflag = 'A' AND l_linestatus = 'F'))",
     column_A="l_returnflag", column_B="l_linestatus", value_pairs_set=[["N", "O"], ["A", "F"]], mostly=0.5)
_row("r27_multicolumn_sum", "lineitem", "multicolumn_sum_to_equal", None,
     "coalesce(l_linenumber + l_suppkey <> 7, true)", column_list=["l_linenumber", "l_suppkey"], sum_total=7,
     mostly=0.01)
_row("r45_like", "part", "column_values_to_match_like_pattern", "p_type", "p_type NOT LIKE '%E%'", like_pattern="%E%",
     mostly=0.2)
_row("r46_not_like", "part", "column_values_to_not_match_like_pattern", "p_brand", "p_brand LIKE 'Brand#1_'",
     like_pattern="Brand#1_")
_row("r47_like_list", "orders", "column_values_to_match_like_pattern_list", "o_orderpriority",
     "NOT (o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '%LOW')", like_pattern_list=["1-%", "%LOW"], mostly=0.2)
_row("r48_not_like_list", "orders", "column_values_to_not_match_like_pattern_list", "o_orderpriority",
     "(o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '%LOW')", like_pattern_list=["1-%", "%LOW"])
_row("r51_json_parseable", "events", "column_values_to_be_json_parseable", "props", "NOT json_valid(props)")
_row("r52_json_schema", "events", "column_values_to_match_json_schema", "props",
     "NOT coalesce(json_type(props) = 'OBJECT' AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') "
     "AND CAST(json_extract_string(props, '$.k') AS DOUBLE) <= 50, false)",
     json_schema={"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 50}}},
     mostly=0.4)

# --- statistics ------------------------------------------------------------------------------------------
_value("r28_min_between", "orders", "column_min_to_be_between", "o_totalprice", "min(o_totalprice)", 0, 5000)
_value("r29_max_between", "orders", "column_max_to_be_between", "o_totalprice", "max(o_totalprice)", 100000, 400000)
_value("r30_mean_between", "lineitem", "column_mean_to_be_between", "l_discount", "avg(l_discount)", 0.01, 0.06)
_value("r31_stdev_between", "lineitem", "column_stdev_to_be_between", "l_quantity", "stddev_samp(l_quantity)", 10, 20)
_value("r32_sum_between", "lineitem", "column_sum_to_be_between", "l_linenumber", "sum(l_linenumber)", 1, None)
_value("r33_median_between", "orders", "column_median_to_be_between", "o_totalprice",
       "quantile_cont(o_totalprice, 0.5)", 100000, 300000)
_value("r34_unique_count_between", "lineitem", "column_unique_value_count_to_be_between", "l_suppkey",
       "count(DISTINCT l_suppkey)", 1, 100000)
_value("r35_unique_proportion_between", "lineitem", "column_proportion_of_unique_values_to_be_between", "l_orderkey",
       "count(DISTINCT l_orderkey)::DOUBLE / count(l_orderkey)", 0.2, 0.3)

_row("r21_unique", "lineitem", "column_values_to_be_unique", "l_orderkey", "rn > 1")
_row("r22_compound_unique", "lineitem", "compound_columns_to_be_unique", None, "false",
     column_list=["l_orderkey", "l_linenumber"])


def _replace_oracles():
    from tablewarden.plans.registry import ORACLE
    for name, cols, col in [("r21_unique", "l_orderkey", "l_orderkey"),
                            ("r22_compound_unique", "l_orderkey, l_linenumber", "")]:
        kind = "column_values_to_be_unique" if col else "compound_columns_to_be_unique"
        ORACLE[name] = f"""
          SELECT '{kind}' AS expectation, '{col}' AS column_name, n = d AS success, n AS element_count,
                 n - d AS unexpected_count, round(100.0 * (n - d) / n, 6) AS unexpected_pct
          FROM (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS d
                FROM (SELECT count(*) AS c FROM lineitem GROUP BY {cols}))"""


_replace_oracles()

UNIQUE_MOSTLY = """
  SELECT 'column_values_to_be_unique' AS expectation, 'o_custkey' AS column_name,
         1.0 - bad::DOUBLE / n >= 0.01 - 1e-12 AS success, n AS element_count, bad AS unexpected_count,
         round(100.0 * bad / n, 6) AS unexpected_pct
  FROM (SELECT CAST(sum(c) AS BIGINT) AS n, CAST(coalesce(sum(CASE WHEN c > 1 THEN c END), 0) AS BIGINT) AS bad
        FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey))"""


@query("r21_unique_mostly", UNIQUE_MOSTLY)
def _q(t):
    return _view(R.validate(t.orders, [R.rule("column_values_to_be_unique", "o_custkey", mostly=0.01)]))


def _set(name, kind, ok, values):
    wanted = ", ".join(f"'{v}'" for v in values)
    sql = f"""
      SELECT '{kind}' AS expectation, 'o_orderstatus' AS column_name, ({ok}) AS success, n AS element_count,
             rest AS unexpected_count, round(100.0 * rest / n, 6) AS unexpected_pct, seen AS observed_text
      FROM (SELECT count(o_orderstatus) AS n,
                   count(*) FILTER (WHERE o_orderstatus NOT IN ({wanted})) AS rest,
                   coalesce(array_to_string(list_sort(list(DISTINCT o_orderstatus)
                            FILTER (WHERE o_orderstatus IN ({wanted}))), ','), '') AS seen,
                   count(DISTINCT CASE WHEN o_orderstatus IN ({wanted}) THEN o_orderstatus END) AS hit
            FROM orders)"""

    @query(name, sql)
    def _q(t):
        return R.validate(t.orders, [R.rule(kind, "o_orderstatus", value_set=values)]).select(
            "expectation", "column_name", "success", "element_count", "unexpected_count",
            F.round("unexpected_pct", 6).alias("unexpected_pct"), "observed_text")


_set("r36_distinct_in_set", "column_distinct_values_to_be_in_set", "rest = 0", ["F", "O", "P", "X"])
_set("r37_distinct_contain_set", "column_distinct_values_to_contain_set", "hit = 2", ["F", "O"])
_set("r38_distinct_equal_set", "column_distinct_values_to_equal_set", "rest = 0 AND hit = 2", ["F", "O"])


@query("r39_quantiles_between", """
  SELECT q25 BETWEEN 10 AND 16 AND q50 BETWEEN 20 AND 30 AND q90 BETWEEN 40 AND 50 AS success,
         concat_ws(',', q25::VARCHAR, q50::VARCHAR, q90::VARCHAR) AS observed_text
  FROM (SELECT quantile_disc(l_quantity, 0.25) AS q25, quantile_disc(l_quantity, 0.5) AS q50,
               quantile_disc(l_quantity, 0.9) AS q90 FROM lineitem)""")
def _q(t):
    spec = {"quantiles": [0.25, 0.5, 0.9], "value_ranges": [[10, 16], [20, 30], [40, 50]]}
    return R.validate(t.lineitem, [R.rule("column_quantile_values_to_be_between", "l_quantity", quantile_ranges=spec)]) \
        .select("success", "observed_text")


def _order_sql(kind, column, order, table, bad, mostly):
    return f"""
      SELECT '{kind}' AS expectation, '{column}' AS column_name,
             1.0 - bad::DOUBLE / n >= {mostly} - 1e-12 AS success, n AS element_count, bad AS unexpected_count,
             round(100.0 * bad / n, 6) AS unexpected_pct
      FROM (SELECT count(*) AS n, CAST(coalesce(sum(CASE WHEN {bad} THEN 1 ELSE 0 END), 0) AS BIGINT) AS bad
            FROM (SELECT {column} AS v, lag({column}) OVER (ORDER BY {order}, {column}) AS p
                  FROM {table} WHERE {column} IS NOT NULL))"""


@query("r40_increasing", _order_sql("column_values_to_be_increasing", "o_totalprice", "o_orderdate", "orders", "p > v", .3))
def _q(t):
    return _view(R.validate(t.orders, [
        R.rule("column_values_to_be_increasing", "o_totalprice", order_by="o_orderdate", mostly=.3)]))


@query("r40_strictly_increasing", _order_sql("column_values_to_be_increasing", "event_id", "ts", "events", "p >= v", .9))
def _q(t):
    return _view(R.validate(t.events, [
        R.rule("column_values_to_be_increasing", "event_id", order_by="ts", strictly=True, mostly=.9)]))


@query("r41_decreasing", _order_sql("column_values_to_be_decreasing", "l_quantity", "l_orderkey", "lineitem", "p < v", .5))
def _q(t):
    return _view(R.validate(t.lineitem, [
        R.rule("column_values_to_be_decreasing", "l_quantity", order_by="l_orderkey", mostly=.5)]))


@query("r42_z_scores", """
  SELECT 'column_value_z_scores_to_be_less_than' AS expectation, 'value' AS column_name,
         1.0 - bad::DOUBLE / n >= 0.9 - 1e-12 AS success, n AS element_count, bad AS unexpected_count,
         round(100.0 * bad / n, 6) AS unexpected_pct
  FROM (SELECT count(value) AS n, count(*) FILTER (WHERE abs((value - m) / s) >= 1.5) AS bad
        FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events))""")
def _q(t):
    return _view(R.validate(t.events, [R.rule("column_value_z_scores_to_be_less_than", "value", threshold=1.5, mostly=.9)]))


@query("r43_kl_divergence", """
  SELECT kl < 0.1 AS success, round(kl, 4) AS observed_value
  FROM (SELECT sum(p * ln(p / w)) AS kl
        FROM (SELECT o_orderstatus AS k, count(*)::DOUBLE / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY 1)
        JOIN (VALUES ('F', 0.3), ('O', 0.3), ('P', 0.4)) AS q(k, w) USING (k))""")
def _q(t):
    part = {"values": ["F", "O", "P"], "weights": [0.3, 0.3, 0.4]}
    return R.validate(t.orders, [R.rule("column_kl_divergence_to_be_less_than", "o_orderstatus",
                                        partition_object=part, threshold=0.1)]) \
        .select("success", F.round("observed_value", 4).alias("observed_value"))


@query("r44_most_common", """
  WITH c AS (SELECT c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1)
  SELECT bool_or(k IN ('BUILDING', 'MACHINERY')) AS success, CAST(max(n) AS DOUBLE) AS observed_value,
         min(k) AS observed_text
  FROM c WHERE n = (SELECT max(n) FROM c)""")
def _q(t):
    return R.validate(t.customer, [R.rule("column_most_common_value_to_be_in_set", "c_mktsegment",
                                          value_set=["BUILDING", "MACHINERY"], ties_okay=True)]) \
        .select("success", "observed_value", "observed_text")


@query("r49_strftime", _row_sql("column_values_to_match_strftime_format", "d", """
  (SELECT CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END
          AS d FROM orders)""", "count(d)", "try_strptime(d, '%Y-%m-%d') IS NULL", 0.5))
def _q(t):
    d = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")) \
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return _view(R.validate(t.orders.select(d.alias("d")), [
        R.rule("column_values_to_match_strftime_format", "d", strftime_format="%Y-%m-%d", mostly=.5)]))


@query("r50_dateutil_parseable", _row_sql("column_values_to_be_dateutil_parseable", "d", """
  (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'n/k ' || o_orderkey::VARCHAR ELSE strftime(o_orderdate, '%d/%m/%Y') END
          AS d FROM orders)""", "count(d)", "d LIKE 'n/k%'", 0.5))
def _q(t):
    d = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("n/k "), F.col("o_orderkey").cast("string"))) \
        .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return _view(R.validate(t.orders.select(d.alias("d")), [
        R.rule("column_values_to_be_dateutil_parseable", "d", mostly=.5)]))


@query("r53_row_count_equals_other", """
  SELECT (SELECT count(*) FROM orders) = (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS success,
         CAST((SELECT count(*) FROM orders) AS DOUBLE) AS observed_value""")
def _q(t):
    other = t.lineitem.select("l_orderkey").distinct()
    return R.validate(t.orders, [R.rule("table_row_count_to_equal_other_table", other=other)]) \
        .select("success", "observed_value")

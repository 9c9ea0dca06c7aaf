"""Rule suites: one job, the whole catalogue of types, isolation, metamorphic checks."""

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import rules as R
from tablewarden.operators import sql_rules as Q

# fixed values: the expectation types a suite may name
TYPES = """column_to_exist table_columns_to_match_set table_columns_to_match_ordered_list table_column_count_to_equal
table_column_count_to_be_between column_values_to_be_of_type column_values_to_be_in_type_list table_row_count_to_be_between
table_row_count_to_equal column_values_to_not_be_null column_values_to_be_null column_values_to_be_in_set
column_values_to_not_be_in_set column_values_to_be_between column_value_lengths_to_be_between column_value_lengths_to_equal
column_values_to_match_regex column_values_to_not_match_regex column_values_to_match_regex_list
column_values_to_not_match_regex_list column_values_to_be_unique compound_columns_to_be_unique
select_column_values_to_be_unique_within_record column_pair_values_to_be_equal column_pair_values_a_to_be_greater_than_b
column_pair_values_to_be_in_set multicolumn_sum_to_equal column_min_to_be_between column_max_to_be_between
column_mean_to_be_between column_stdev_to_be_between column_sum_to_be_between column_median_to_be_between
column_unique_value_count_to_be_between column_proportion_of_unique_values_to_be_between column_distinct_values_to_be_in_set
column_distinct_values_to_contain_set column_distinct_values_to_equal_set column_quantile_values_to_be_between
column_values_to_be_increasing column_values_to_be_decreasing column_value_z_scores_to_be_less_than
column_kl_divergence_to_be_less_than column_most_common_value_to_be_in_set column_values_to_match_like_pattern
column_values_to_not_match_like_pattern column_values_to_match_like_pattern_list column_values_to_not_match_like_pattern_list
column_values_to_match_strftime_format column_values_to_be_dateutil_parseable column_values_to_be_json_parseable
column_values_to_match_json_schema table_row_count_to_equal_other_table""".split()


def orders(spark):
    """400 rows with duplicated ids, foreign and missing countries, zero quantities, bad codes, negative totals."""
    i = F.col("i")
    return spark.range(400).withColumnRenamed("id", "i").select(
        F.when(i < 10, F.lit("ID0")).otherwise(F.concat(F.lit("ID"), i.cast("string"))).alias("id"),
        F.when(i < 5, "XX").when(i < 10, None).otherwise("EG").alias("country"), F.when(i < 3, 0).otherwise(i % 9 + 1).cast("bigint").alias("qty"),
        (i * 1.5 + 1).alias("price"), F.when(i < 4, -1.0).otherwise(i * 2.0).alias("total"), F.when(i < 7, "bad").otherwise(F.concat(F.lit("C-"), i.cast("string"))).alias("code"))


SUITE = [
    R.rule("expect_table_row_count_to_be_between", min_value=1, max_value=1000), R.rule("column_values_to_not_be_null", "country"),
    R.rule("column_values_to_be_in_set", "country", value_set=["EG"]), R.rule("column_values_to_be_between", "qty", min_value=1, max_value=9),
    R.rule("column_values_to_match_regex", "code", regex="^C-[0-9]+$"), R.rule("column_values_to_be_between", "total", min_value=0),
    R.rule("column_mean_to_be_between", "price", min_value=0, max_value=1000), R.rule("column_max_to_be_between", "price", max_value=1000),
    R.rule("column_pair_values_a_to_be_greater_than_b", column_A="price", column_B="qty", mostly=0.5),
]


def test_all_types_registered():
    assert len(TYPES) == 53
    assert set(TYPES) <= set(R.rule_types())


def test_defect_counts(spark):
    got = {(r["expectation"], r["column_name"]): r for r in R.validate(orders(spark), SUITE).collect()}
    assert got[("column_values_to_not_be_null", "country")]["unexpected_count"] == 5
    assert got[("column_values_to_be_in_set", "country")]["unexpected_count"] == 5
    assert got[("column_values_to_be_in_set", "country")]["element_count"] == 395
    assert got[("column_values_to_be_between", "qty")]["unexpected_count"] == 3
    assert got[("column_values_to_match_regex", "code")]["unexpected_count"] == 7
    assert got[("column_values_to_be_between", "total")]["unexpected_count"] == 4
    assert got[("column_mean_to_be_between", "price")]["success"]


def test_unique_counts_extra_copies(spark):
    row = R.validate(orders(spark), [R.rule("column_values_to_be_unique", "id")]).first()
    assert (row["element_count"], row["unexpected_count"], row["reason"]) == (400, 9, "9 duplicated row(s)")
    row = R.validate(orders(spark), [R.rule("column_values_to_be_unique", "id", mostly=0.5)]).first()
    assert (row["unexpected_count"], row["success"]) == (10, True)


def test_suite_is_one_job(spark):
    df = orders(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spark.sparkContext.setJobGroup("suite", "suite")
        R.validate(df, SUITE).collect()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("suite")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


WIDE = SUITE + [R.rule("column_values_to_be_unique", "id"), R.rule("column_unique_value_count_to_be_between", "country", min_value=2, max_value=2), R.rule("compound_columns_to_be_unique", column_list=["country", "qty"]),
                R.rule("column_proportion_of_unique_values_to_be_between", "code", min_value=0.5), R.rule("table_columns_to_match_set", column_set=["id", "country", "qty", "price", "total", "code"])]


def jobs_of(spark, group, run):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spark.sparkContext.setJobGroup(group, group)
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_fourteen_rules_with_distinct_values_are_one_job(spark):
    assert len(WIDE) == 14
    df = orders(spark)
    assert jobs_of(spark, "wide", lambda: R.validate(df, WIDE).collect()) == 1
    failed = [r["rule_id"] for r in R.validate(df, WIDE).collect() if not r["success"]]

    def with_samples():
        R.validate(df, WIDE).collect()
        R.samples(df, WIDE, failed).collect()
    assert jobs_of(spark, "samples", with_samples) == 2


def test_distinct_rules_share_one_scan_and_one_shuffle(spark, tmp_path):
    orders(spark).write.parquet(str(tmp_path / "o"))
    df = spark.read.parquet(str(tmp_path / "o"))
    rules = [R.rule("column_values_to_be_unique", c) for c in ("id", "code", "qty", "price")] + [R.rule("compound_columns_to_be_unique", column_list=["id", "code"])]
    plan = R.validate(df, rules)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1
    executed = jobs_of(spark, "distinct", lambda: R.validate(df, rules).collect())
    assert executed == 1


def test_distinct_counts_of_odd_keys(spark):
    df = spark.createDataFrame([("a", None, 0.0, 1), ("a", None, -0.0, 2), (None, "a", float("nan"), 3), (None, None, float("nan"), 4), ("a", "a", 1.0, 4)], "x string, y string, z double, p int")
    rules = [R.rule("compound_columns_to_be_unique", column_list=["x", "y"]), R.rule("column_values_to_be_unique", "z"), R.rule("column_unique_value_count_to_be_between", "x", max_value=1)]
    got = [(r["element_count"], r["unexpected_count"], r["observed_value"]) for r in R.validate(df, rules).collect()]
    assert got == [(4, 1, None), (5, 2, None), (None, None, 1.0)]
    by = {(r["p"], r["expectation"]): r for r in R.validate_by(df, ["p"], rules).collect()}
    assert len(by) == 12 and by[3, "column_unique_value_count_to_be_between"]["observed_value"] == 0.0 and by[4, "compound_columns_to_be_unique"]["element_count"] == 1
    empty = R.validate(df.limit(0), rules).collect()
    assert [r["success"] for r in empty] == [True, True, True]


def test_isolation_of_a_rule_that_fails_at_run_time(spark):
    @R.register("explode_at_run_time")
    def _boom(df, r):
        bad = F.raise_error(F.lit("boom")).cast("boolean")
        return R.row_rule(bad, F.count(F.lit(1)), r.kwargs, F.lit("x"))
    rows = R.validate_isolated(orders(spark), [SUITE[1], R.rule("explode_at_run_time"), SUITE[3]])
    by = {r["expectation"]: r for r in rows}
    assert by["explode_at_run_time"]["reason"].startswith("error")
    assert by["column_values_to_be_between"]["unexpected_count"] == 3


def test_order_of_rows_does_not_matter(spark):
    df = orders(spark)
    shuffled = df.repartition(7, "code").sortWithinPartitions(F.desc("price"))
    key = lambda rows: sorted(str(r.asDict()) for r in rows)
    assert key(R.validate(df, SUITE).collect()) == key(R.validate(shuffled, SUITE).collect())


def test_counts_of_two_halves_add_up(spark):
    df = orders(spark)
    def bad(x):
        return {(r["expectation"], r["column_name"]): r["unexpected_count"] for r in R.validate(x, SUITE[1:6]).collect()}
    a, b, whole = bad(df.where("price < 200")), bad(df.where("price >= 200")), bad(df)
    assert {k: a[k] + b[k] for k in whole} == whole


def test_hot_order_key(spark):
    """A third of all rows share one order key and one value; the result is still exact."""
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("o"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).alias("v"))
    rows = sorted((r["o"], r["v"]) for r in df.collect())
    want = sum(1 for x, y in zip(rows, rows[1:]) if x[1] > y[1])
    got = R.validate(df, [R.rule("column_values_to_be_increasing", "v", order_by="o")]).first()
    assert (got["element_count"], got["unexpected_count"]) == (900, want)


def test_empty_table_passes(spark):
    row = R.validate(orders(spark).where("1 = 0"), [SUITE[1]]).first()
    assert row["success"] and row["element_count"] == 0


@pytest.mark.parametrize("query,value", [("SELECT COUNT(*) FROM t", True), ("SELECT a FROM t", False), ("SELECT (SELECT max(a) FROM t) AS m, b FROM t", False),
                                         ("WITH x AS (SELECT count(*) AS n FROM t) SELECT * FROM x", False), ("select distinct coalesce(sum(a), 0) from t", True)])
def test_value_mode(spark, query, value):
    spark.range(3).selectExpr("id AS a", "id AS b").createOrReplaceTempView("t")
    assert (Q.value_of(spark.sql(query)) is not None) is value


@pytest.mark.parametrize("query", ["", " ; ", "DROP TABLE t", "SELECT 1; SELECT 2", "INSERT INTO t SELECT 1", "SELECT 1) x; DROP TABLE t; SELECT (1"])
def test_only_queries(spark, query):
    with pytest.raises(ValueError):
        Q.check(spark, query)


def test_names_in_queries(spark):
    assert Q.addressed("SELECT 'db.tab ${object}' FROM `DB`.tab JOIN ${object} -- db.tab", "v", "db.tab") == "SELECT 'db.tab ${object}' FROM v JOIN v -- db.tab"
    row = Q.evaluate(spark.range(5).withColumnRenamed("id", "a"), Q.sql_rule("select ${property} from data where a > 2 -- ;", column="a", mustBeLessThan=1)).first()
    assert not row["success"] and row["unexpected_count"] == 2


@pytest.mark.parametrize("query,want", [
    ("SELECT shop.orders.a FROM shop.orders WHERE shop.orders.a > 2", 2), ("SELECT orders.a FROM `Shop`.`Orders` /* it's ${property} */ WHERE orders.a > 2 -- shop.orders", 2),
    ('SELECT "shop.orders", a FROM data WHERE ${property} > 2', 2), ("SELECT data.a FROM data JOIN shop.orders o ON o.a = data.a WHERE o.a > 3", 1),
    ("WITH orders AS (SELECT a FROM shop.orders) SELECT orders.a FROM orders WHERE orders.a > 1", 3)])
def test_qualified_names(spark, query, want):
    row = Q.evaluate(spark.range(5).withColumnRenamed("id", "a"), Q.sql_rule(query, column="a", mustBeGreaterThan=-1), table="shop.orders").first()
    assert row["success"] and row["observed_value"] == want, row["reason"]


def test_a_column_named_like_the_table(spark):
    df = spark.range(3).selectExpr("id AS data", "struct(id AS x) AS orders")
    row = Q.evaluate(df, Q.sql_rule("SELECT data, orders FROM data WHERE data > 0", mustBe=2), table="shop.t").first()
    assert row["success"], row["reason"]


def test_two_threads_at_once(spark):
    from concurrent.futures import ThreadPoolExecutor
    frames = [spark.range(n).withColumnRenamed("id", "a") for n in range(1, 9)]
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda df: Q.evaluate(df, Q.sql_rule("SELECT count(*) FROM data", mustBeGreaterThan=0)).first()["observed_value"], frames))
    assert got == [float(n) for n in range(1, 9)]


def test_null_partition_value_is_a_partition(spark):
    df = spark.range(60).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("p"), (F.col("id") % 7).alias("v"), F.col("id").alias("o"))
    rules = [R.rule("column_values_to_be_unique", "v"), R.rule("column_median_to_be_between", "v", min_value=0), R.rule("column_values_to_be_increasing", "v", order_by="o", mostly=0.1)]
    got = {(r["p"], r["expectation"]): r for r in R.validate_by(df, ["p"], rules).collect()}
    assert len(got) == 9
    assert got[(None, "column_values_to_be_unique")]["element_count"] == 20
    assert got[(None, "column_median_to_be_between")]["observed_value"] is not None
    assert got[(None, "column_values_to_be_increasing")]["element_count"] == 20

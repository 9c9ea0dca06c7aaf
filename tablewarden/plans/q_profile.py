"""Queries of profiling, relationships and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.operators import profile as P
from tablewarden.plans.registry import query


def _each(columns, template, table):
    """One SELECT per column, glued together."""
    return " UNION ALL ".join(template.format(c=c, t=table) for c in columns)


def _r(df, *names, digits=6):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
COUNT_SQL = """
  SELECT '{c}' AS "column", count(*) AS rows, count({c}) AS non_null, count(*) - count({c}) AS nulls,
         round((count(*) - count({c}))::DOUBLE / count(*), 6) AS null_rate,
         count(*) FILTER (WHERE {c}::VARCHAR = '') AS empty_string, count(*) FILTER (WHERE regexp_matches({c}::VARCHAR, '^\\s+$')) AS whitespace_only,
         count(DISTINCT {c}) AS "distinct", round(count(DISTINCT {c})::DOUBLE / count({c}), 6) AS distinct_rate,
         count({c}) - count(DISTINCT {c}) AS duplicate_rows,
         count(DISTINCT {c}) = count(*) AS is_candidate_key, count(DISTINCT {c}) = 1 AS constant
  FROM {t}"""


@query("p01_counts", _each(CUST, COUNT_SQL, "customer"))
def _q(t):
    return _r(P.counts(t.customer), "null_rate", "distinct_rate")


LEN_SQL = """
  SELECT '{c}' AS "column", CAST(min(n) AS INTEGER) AS min, CAST(max(n) AS INTEGER) AS max, round(avg(n), 6) AS mean,
         quantile_cont(n, 0.5) AS median, round(stddev_pop(n), 6) AS stddev, quantile_cont(n, 0.05) AS p05,
         quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.75) AS p75, quantile_cont(n, 0.95) AS p95,
         count(DISTINCT n) AS distinct_lengths, count(DISTINCT n) = 1 AS fixed_width
  FROM (SELECT length({c}) AS n FROM {t} WHERE {c} IS NOT NULL)"""


@query("p02_length", _each(["text", "lang", "source"], LEN_SQL, "documents"))
def _q(t):
    return _r(P.length(t.documents), "mean", "stddev").drop("histogram", "p50")


MASK_SQL = """
  SELECT '{c}' AS "column", CAST(rank AS INTEGER) AS rank, mask, n, round(n::DOUBLE / total, 6) AS rate, distinct_masks,
         round(dominant::DOUBLE / total, 6) AS dominant_mask_rate FROM (
    SELECT mask, n, row_number() OVER (ORDER BY n DESC, mask) AS rank, CAST(sum(n) OVER () AS BIGINT) AS total,
           count(*) OVER () AS distinct_masks, max(n) OVER () AS dominant FROM (
      SELECT regexp_replace(regexp_replace(left({c}, 64), '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') AS mask, count(*) AS n
      FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)) WHERE rank <= 10"""


@query("p03_masks", _each(["p_name", "p_brand", "p_type"], MASK_SQL, "part"))
def _q(t):
    return _r(P.masks(t.part), "rate", "dominant_mask_rate")


CHARSET_SQL = """
  SELECT '{c}' AS "column", round(avg(regexp_matches({c}, '^[0-9]+$')::INT), 6) AS digits_only_rate,
         round(avg(regexp_matches({c}, '^\\pL+$')::INT), 6) AS alpha_only_rate,
         round(avg(regexp_matches({c}, '^[\\pL\\pN]+$')::INT), 6) AS alphanumeric_rate,
         round(avg(regexp_matches({c}, '[^\\pL\\pN\\s]')::INT), 6) AS has_punctuation_rate,
         round(avg(regexp_matches({c}, '\\s')::INT), 6) AS has_whitespace_rate,
         round(avg(regexp_matches({c}, '^0[0-9]+$')::INT), 6) AS leading_zeros_rate,
         round(avg((regexp_matches({c}, '[A-Za-z]'))::INT), 6) AS latin
  FROM {t} WHERE {c} IS NOT NULL"""


@query("p04_charset", _each(["text", "lang", "source"], CHARSET_SQL, "documents"))
def _q(t):
    names = ["digits_only_rate", "alpha_only_rate", "alphanumeric_rate", "has_punctuation_rate", "has_whitespace_rate",
             "leading_zeros_rate", "latin"]
    return _r(P.charset(t.documents).select("column", *names), *names)


@query("p04_unicode_categories", " UNION ALL ".join(f"""
  SELECT '{c}' AS category, sum(length(regexp_replace(text, '[^\\p{{{c}}}]', '', 'g')))::BIGINT AS n,
         round(sum(length(regexp_replace(text, '[^\\p{{{c}}}]', '', 'g'))) / sum(length(text)), 6) AS rate
  FROM documents HAVING sum(length(regexp_replace(text, '[^\\p{{{c}}}]', '', 'g'))) > 0""" for c in P.UNICODE_CATEGORIES))
def _q(t):
    return _r(P.unicode_categories(t.documents, ["text"]), "rate").drop("column")


NUM_SQL = """
  SELECT '{c}' AS "column", count(*) AS parsed_count, min(v) AS min, max(v) AS max, round(sum(v), 2) AS sum, round(avg(v), 4) AS mean,
         round(quantile_cont(v, 0.5), 4) AS median, round(stddev_pop(v), 4) AS stddev, round(quantile_cont(v, 0.01), 4) AS p01,
         round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.75), 4) AS p75, round(quantile_cont(v, 0.99), 4) AS p99,
         count(*) FILTER (WHERE v = 0) AS zero_count, count(*) FILTER (WHERE v < 0) AS negative_count,
         round(avg(power((v - m) / s, 3)), 4) AS skewness, round(avg(power((v - m) / s, 4)) - 3, 4) AS kurtosis,
         count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers_iqr,
         round(avg((v = floor(v))::INT), 6) AS integer_valued_rate,
         [count(*) FILTER (WHERE least(floor((v - lo) / (hi - lo) * 20), 19) = 0), count(*) FILTER (WHERE least(floor((v - lo) / (hi - lo) * 20), 19) = 1), count(*) FILTER (WHERE least(floor((v - lo) / (hi - lo) * 20), 19) = 2), count(*) FILTER (WHERE least(floor((v - lo) / (hi - lo) * 20), 19) = 3), count(*) FILTER (WHERE least(floor((v - lo) / (hi - lo) * 20), 19) = 4), count(*) FILTER (WHERE least(floor((v - lo) / (hi - lo) * 20), 19) = 5), count(*) FILTER (WHERE least(floor((v - lo) / (hi - lo) * 20), 19) = 6), count(*) FILTER (WHERE least(floor((v - lo) / (hi - lo) * 20), 19) = 7), count(*) FILTER (WHERE least(floor((v - lo) / (hi - lo) * 20), 19) = 8), count(*) FILTER (WHERE least(floor((v - lo) / (hi - lo) * 20), 19) = 9), count(*) FILTER (WHERE least(floor((v - lo) / (hi - lo) * 20), 19) = 10), count(*) FILTER (WHERE least(floor((v - lo) / (hi - lo) * 20), 19) = 11), count(*) FILTER (WHERE least(floor((v - lo) / (hi - lo) * 20), 19) = 12), count(*) FILTER (WHERE least(floor((v - lo) / (hi - lo) * 20), 19) = 13), count(*) FILTER (WHERE least(floor((v - lo) / (hi - lo) * 20), 19) = 14), count(*) FILTER (WHERE least(floor((v - lo) / (hi - lo) * 20), 19) = 15), count(*) FILTER (WHERE least(floor((v - lo) / (hi - lo) * 20), 19) = 16), count(*) FILTER (WHERE least(floor((v - lo) / (hi - lo) * 20), 19) = 17), count(*) FILTER (WHERE least(floor((v - lo) / (hi - lo) * 20), 19) = 18), count(*) FILTER (WHERE least(floor((v - lo) / (hi - lo) * 20), 19) = 19)] AS histogram
  FROM (SELECT {c}::DOUBLE AS v FROM {t}),
       (SELECT avg({c}) AS m, stddev_pop({c}) AS s, quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3,
               min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM {t})"""


@query("p05_numeric", _each(["o_totalprice", "o_custkey"], NUM_SQL, "orders"))
def _q(t):
    df = P.numeric(t.orders, ["o_totalprice", "o_custkey", "o_orderstatus"])
    keep = ["column", "parsed_count", "min", "max", "sum", "mean", "median", "stddev", "p01", "p25", "p75", "p99",
            "zero_count", "negative_count", "skewness", "kurtosis", "outliers_iqr", "integer_valued_rate", "histogram"]
    df = _r(df.select(*keep), "mean", "median", "stddev", "p01", "p25", "p75", "p99", "skewness", "kurtosis", digits=4)
    return _r(_r(df, "integer_valued_rate"), "sum", digits=2)


@query("p06_temporal", """
  WITH e AS (SELECT 'ts' AS c, event_id AS o, ts AS t FROM events
             UNION ALL SELECT 'day', event_id, CAST(strftime(ts, '%Y-%m-%d') AS TIMESTAMP) FROM events),
       l AS (SELECT c, t, lag(t) OVER (PARTITION BY c ORDER BY o, t) AS p FROM e)
  SELECT c AS "column", strftime(min(t), '%Y-%m-%d %H:%M:%S') AS min, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS max, CAST(floor(epoch(max(t))) - floor(epoch(min(t))) AS BIGINT) // 86400 AS range_days,
         round(count(*) FILTER (WHERE t >= p)::DOUBLE / (count(*) - 1), 6) AS monotonic_rate,
         count(*) FILTER (WHERE t > TIMESTAMP '2024-01-15') AS future_count,
         CASE WHEN c = 'ts' THEN 'second' ELSE 'day' END AS granularity FROM l GROUP BY c""")
def _q(t):
    df = t.events.select("event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    out = _r(P.temporal(df, "event_id", now="2024-01-15 00:00:00"), "monotonic_rate").drop("by_year")
    return out.withColumn("min", F.date_format("min", "yyyy-MM-dd HH:mm:ss")).withColumn("max", F.date_format("max", "yyyy-MM-dd HH:mm:ss"))


FREQ_SQL = """
  SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS total, count(*) AS "distinct",
         round(-sum(n / s * log2(n / s)), 6) AS entropy_bits, round(-sum(n / s * log2(n / s)) / log2(max(s)), 6) AS normalized_entropy,
         count(*) <= 50 AS is_categorical, round(sum(n) FILTER (WHERE r <= 10) / max(s), 6) AS coverage_of_top_10,
         max(CASE WHEN r = 1 THEN v END) AS top_value
  FROM (SELECT v, n, s, row_number() OVER (ORDER BY n DESC, v) AS r FROM (
          SELECT {c}::VARCHAR AS v, count(*)::DOUBLE AS n, sum(count(*)) OVER () AS s FROM {t} GROUP BY {c}))"""


@query("p07_frequency", _each(["l_returnflag", "l_suppkey", "l_orderkey"], FREQ_SQL, "lineitem"))
def _q(t):
    df = P.frequency(t.lineitem, ["l_returnflag", "l_suppkey", "l_orderkey"])
    return _r(df.withColumn("top_value", F.col("top_values")[0]["value"]).drop("top_values"),
              "entropy_bits", "normalized_entropy", "coverage_of_top_10")


@query("p08_summary", _each(["p_partkey", "p_size", "p_type"], """
  SELECT '{c}' AS "column", min({c})::VARCHAR AS min, max({c})::VARCHAR AS max, round(avg(TRY_CAST({c}::VARCHAR AS DOUBLE)), 4) AS avg,
         round(stddev_samp(TRY_CAST({c}::VARCHAR AS DOUBLE)), 4) AS std, count({c}) AS count, 0.0::DOUBLE AS null_percentage FROM {t}""", "part"))
def _q(t):
    return _r(P.summarize(t.part, ["p_partkey", "p_size", "p_type"]).select(
        "column", "min", "max", "avg", "std", "count", "null_percentage"), "avg", "std", digits=4)


METRIC_SQL = """
  WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'No' END AS flag, CAST(event_id AS VARCHAR) AS amount,
                    strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen, lpad(CAST(user_id AS VARCHAR), 6, '0') AS zeros, value FROM events)
  SELECT * FROM (VALUES ('flag', 'boolean', true, false, false), ('amount', 'integer', false, true, false),
    ('seen', 'timestamp', false, false, true), ('zeros', 'string', false, false, false), ('value', 'number', false, false, false))
    v("column", logical_type, coerced_boolean, coerced_numeric, coerced_datetime)
  JOIN (SELECT 'flag' AS "column", count(DISTINCT flag) AS unique_count, NULL::DOUBLE AS mean FROM e
        UNION ALL SELECT 'amount', count(DISTINCT amount), round(avg(amount::DOUBLE), 4) FROM e
        UNION ALL SELECT 'seen', count(DISTINCT seen), NULL FROM e UNION ALL SELECT 'zeros', count(DISTINCT zeros), NULL FROM e
        UNION ALL SELECT 'value', count(DISTINCT value), round(avg(value), 4) FROM e) USING ("column")"""


def _sniff(t):
    return t.events.select(
        F.when(F.col("event_id") % 2 == 0, "yes").otherwise("No").alias("flag"), F.col("event_id").cast("string").alias("amount"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen"), F.lpad(F.col("user_id").cast("string"), 6, "0").alias("zeros"), "value")


@query("p09_metrics_and_sniffing", METRIC_SQL)
def _q(t):
    m = P.metrics(_sniff(t))
    return m.join(P.type_hints(m), "column").select("column", "logical_type", "coerced_boolean", "coerced_numeric",
                                                    "coerced_datetime", "unique_count", F.round("mean", 4).alias("mean"))


@query("p10_histogram", """
  WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer),
       c AS (SELECT least(greatest(ceil((c_acctbal - lo) / ((hi - lo) / 10)) - 1, 0), 9) AS bucket, count(*) AS n FROM customer, b GROUP BY 1)
  SELECT CAST(i AS INTEGER) AS bucket, coalesce(n, 0) AS n, round(lo + (hi - lo) / 10 * i, 4) AS bucket_lo
  FROM b, (SELECT unnest(range(10)) AS i) LEFT JOIN c ON c.bucket = i""")
def _q(t):
    return P.histogram(t.customer, ["c_acctbal"]).select("bucket", "n", F.round("bucket_lo", 4).alias("bucket_lo"))


@query("p10_top_values", _each(["c_mktsegment", "c_nationkey"], """
  SELECT * FROM (SELECT '{c}' AS "column", {c}::VARCHAR AS value, count(*) AS n,
    CAST(row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR) AS INTEGER) AS rank FROM {t} GROUP BY {c}) WHERE rank <= 10""", "customer"))
def _q(t):
    return P.top_values(t.customer, ["c_mktsegment", "c_nationkey"])


@query("p11_type_hints", """
  SELECT * FROM (VALUES ('flag', 'boolean'), ('amount', 'string'), ('seen', 'timestamp'), ('zeros', 'string'), ('value', 'number'))
    v("column", logical_type) WHERE (SELECT count(*) FROM events) > 0""")
def _q(t):
    return P.type_hints(P.metrics(_sniff(t)), suppress=["amount"]).select("column", "logical_type")


@query("p12_script_share", """
  SELECT 'lang' AS "column", 0.0 AS share UNION ALL SELECT 'source', 0.0
  UNION ALL SELECT 'text', round(avg(regexp_matches(text, '[ÀàÉéÈèÇçÊêÄäÖöÜüß]')::INT), 6) FROM documents""")
def _q(t):
    return _r(P.script_share(t.documents, pattern="[ÀàÉéÈèÇçÊêÄäÖöÜüß]"), "share")


TRIAGE_SQL = """
  SELECT '{c}' AS "column", round(card, 4) AS cardinality_ratio, round(n, 2) AS avg_value_length, {hint}::DOUBLE AS name_hint_score,
    round(0.2 * CASE WHEN card >= 0.1 THEN least(card * 2, 1.0) WHEN card < 0.01 THEN 0.05 ELSE card * 5 END
        + 0.2 * CASE WHEN n BETWEEN 5 AND 80 THEN least((n - 5) / 75, 1.0) WHEN n < 5 THEN 0.05 ELSE greatest(1.0 - (n - 80) / 200, 0.2) END
        + 0.1 * greatest(0.0, 1.0 - z * 2) + 0.4 * {hint}, 4) AS triage_score
  FROM (SELECT count(DISTINCT {c})::DOUBLE / count(*) AS card, avg(length({c})) AS n, avg(({c} IS NULL)::INT) AS z FROM {t})"""


@query("p13_triage", " UNION ALL ".join(TRIAGE_SQL.format(c=c, t="part", hint=h)
                                        for c, h in (("p_name", 1), ("p_brand", 0), ("p_type", 0))))
def _q(t):
    return P.triage(t.part).select("column", "cardinality_ratio", "avg_value_length", "name_hint_score", "triage_score")


STATS_SQL = """
  SELECT '{c}' AS "column", count(*) AS count, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS "distinct",
         {lo} AS min, {hi} AS max FROM {t}"""


def _stats_sql(cols, table, shown):
    return " UNION ALL ".join(STATS_SQL.format(
        c=c, t=table, lo=f"min({c})::VARCHAR" if c in shown else "NULL::VARCHAR",
        hi=f"max({c})::VARCHAR" if c in shown else "NULL::VARCHAR") for c in cols)


@query("p14_full_stats", _stats_sql(CUST, "customer", ["c_custkey", "c_mktsegment"]))
def _q(t):
    return P.full_stats(t.customer, ["c_custkey", "c_mktsegment"], exact=True)


@query("p15_fill_gaps", """
  SELECT 'p_partkey' AS "column", count(DISTINCT p_partkey) AS ndv, CAST(0 AS BIGINT) AS num_nulls, 'catalog' AS source FROM part
  UNION ALL SELECT 'p_size', count(DISTINCT p_size), count(*) - count(p_size), 'query' FROM part
  UNION ALL SELECT 'p_brand', count(DISTINCT p_brand), count(*) - count(p_brand), 'query' FROM part""")
def _q(t):
    df = t.part.select("p_partkey", "p_size", "p_brand")
    known = t.part.agg(F.count_distinct("p_partkey").alias("ndv")).select(
        F.lit("p_partkey").alias("column"), "ndv", F.lit(0).cast("bigint").alias("num_nulls"),
        F.lit(None).cast("string").alias("min"), F.lit(None).cast("string").alias("max"), F.lit(True).alias("fresh"))
    stale = known.withColumn("column", F.lit("p_size")).withColumn("fresh", F.lit(False))
    return P.fill_gaps(df, known.unionByName(stale)).select("column", "ndv", "num_nulls", "source")


@query("p17_duplicate_rows", """
  SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)) AS duplicate_rows FROM orders""")
def _q(t):
    return P.duplicate_rows(t.orders.select("o_custkey", "o_orderstatus"))


@query("p18_constant_columns", """
  WITH e AS (SELECT 'x' AS one, CASE WHEN o_orderkey % 500 = 0 THEN 'b' ELSE 'a' END AS near, o_orderstatus AS st FROM orders)
  SELECT 'one' AS "column", 'constant' AS kind, CAST(1 AS BIGINT) AS "distinct" UNION ALL
  SELECT 'near', CASE WHEN count(*) FILTER (WHERE near = 'a')::DOUBLE / count(*) >= 0.99 THEN 'near_constant' ELSE 'varied' END, count(DISTINCT near) FROM e
  UNION ALL SELECT 'st', 'varied', count(DISTINCT st) FROM e""")
def _q(t):
    df = t.orders.select(F.lit("x").alias("one"), F.when(F.col("o_orderkey") % 500 == 0, "b").otherwise("a").alias("near"),
                         F.col("o_orderstatus").alias("st"))
    return P.constant_columns(df).select("column", "kind", "distinct")


NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = [(a, b) for i, a in enumerate(NUMS) for b in NUMS[i + 1:]]


@query("p19_pearson", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM lineitem" for a, b in PAIRS))
def _q(t):
    return _r(P.corr(t.lineitem, "pearson", NUMS), "r", digits=4)


RANKED = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in NUMS)


@query("p20_spearman", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM (SELECT {RANKED} FROM lineitem)" for a, b in PAIRS))
def _q(t):
    return _r(P.corr(t.lineitem, "spearman", NUMS), "r", digits=4)


@query("p21_relationship_flags", """
  SELECT * FROM (VALUES ('p_partkey', '', false, false), ('p_retailprice', '', false, false), ('twice', 'p_size', false, false),
    ('p_size', 'twice', false, false), ('one', '', true, false)) v("column", redundant_with, is_constant, is_near_constant)
  WHERE (SELECT abs(corr(p_partkey, p_retailprice)) < 0.95 FROM part)
  UNION ALL SELECT * FROM (VALUES ('p_partkey', 'p_retailprice', false, false), ('p_retailprice', 'p_partkey', false, false), ('twice', 'p_size', false, false),
    ('p_size', 'twice', false, false), ('one', '', true, false)) v("column", redundant_with, is_constant, is_near_constant)
  WHERE (SELECT abs(corr(p_partkey, p_retailprice)) >= 0.95 FROM part)""")
def _q(t):
    df = t.part.select("p_partkey", "p_size", "p_retailprice", (F.col("p_size") * 2 + 1).alias("twice"), F.lit(1).alias("one"))
    return P.relationship_flags(P.corr(df), P.constant_columns(df))


@query("p22_types", """
  SELECT column_name AS "column", CASE column_type WHEN 'BIGINT' THEN 'integer' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'number'
         WHEN 'TIMESTAMP' THEN 'timestamp' END AS logical_type FROM (DESCRIBE orders)""")
def _q(t):
    return P.types(t.orders).select("column", "logical_type")


@query("p23_contract_columns", """
  SELECT 'shop.customer' AS table_name, column_name, CASE column_type WHEN 'BIGINT' THEN 'integer' WHEN 'INTEGER' THEN 'integer'
         WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'number' END AS logical_type FROM (DESCRIBE customer)""")
def _q(t):
    return P.contract_columns(t.customer, "shop.customer").select("table_name", "column_name", "logical_type")


FP_SQL = """
  SELECT '{c}' AS "column", CAST(min(length(v)) AS INTEGER) AS len_min, CAST(max(length(v)) AS INTEGER) AS len_max, round(avg(length(v)), 4) AS len_mean,
         round(stddev_samp(length(v)), 4) AS len_std, CAST(floor(quantile_cont(length(v), 0.5)) AS BIGINT) AS len_p50,
         CAST(floor(quantile_cont(length(v), 0.9)) AS BIGINT) AS len_p90,
         round(sum(length(regexp_replace(v, '[^0-9]', '', 'g'))) / sum(length(v)), 6) AS frac_digit,
         round(sum(length(regexp_replace(v, '[^A-Za-z]', '', 'g'))) / sum(length(v)), 6) AS frac_alpha,
         round(sum(length(regexp_replace(v, '[^A-Z]', '', 'g'))) / sum(length(v)), 6) AS frac_upper,
         round(sum(length(regexp_replace(v, '[^ ]', '', 'g'))) / sum(length(v)), 6) AS frac_space,
         round(least(count(DISTINCT v)::DOUBLE / count(*), 1.0), 6) AS distinct_ratio, count(DISTINCT v) = count(*) AS is_unique,
         count(DISTINCT v) <= 1 AS is_constant, round(avg(len(string_split(v, ' '))), 4) AS token_count_mean
  FROM (SELECT {c}::VARCHAR AS v FROM {t})"""
FP_COLS = ["p_name", "p_brand", "p_type", "p_partkey"]
FP_KEEP = ["column", "len_min", "len_max", "len_mean", "len_std", "len_p50", "len_p90", "frac_digit", "frac_alpha", "frac_upper",
           "frac_space", "distinct_ratio", "is_unique", "is_constant", "token_count_mean"]


@query("p24_fingerprint", _each(FP_COLS, FP_SQL, "part"))
def _q(t):
    return P.fingerprint(t.part, columns=FP_COLS).select(*FP_KEEP)


@query("p24_anonymous_masks", _each(["p_name", "p_type"], """
  SELECT "column", mask, share FROM (
    SELECT '{c}' AS "column", CASE WHEN n < 20 THEN 'other' ELSE mask END AS mask, round(sum(n) / max(total), 4) AS share,
           row_number() OVER (ORDER BY (CASE WHEN n < 20 THEN 1 ELSE 0 END), sum(n) DESC, CASE WHEN n < 20 THEN 'other' ELSE mask END) AS r FROM (
      SELECT mask, n, sum(n) OVER () AS total FROM (
        SELECT regexp_replace(regexp_replace(regexp_replace({c}, '[a-z]', '#', 'g'), '[A-Z]', 'a', 'g'), '#', 'A', 'g') AS mask, count(*) AS n FROM {t} GROUP BY 1))
    GROUP BY CASE WHEN n < 20 THEN 'other' ELSE mask END, CASE WHEN n < 20 THEN 1 ELSE 0 END) WHERE r <= 10""", "part"))
def _q(t):
    return P.fingerprint(t.part, columns=["p_name", "p_type"]).select("column", F.inline("pattern_masks"))


@query("p25_fingerprint_vector")
def _q(t):
    return P.fingerprint_vector(P.fingerprint(t.part, columns=FP_COLS))


@query("p26_signature", """
  SELECT 'p_brand' AS "column", CASE WHEN bool_and(regexp_matches(p_brand, '^Brand#[0-9]{1,2}$')) THEN 'brand' ELSE 'mixed' END AS signature FROM part
  UNION ALL SELECT 'p_type', CASE WHEN count(DISTINCT length(p_type)) = 1 THEN repeat('L', max(length(p_type))) ELSE 'mixed' END FROM part
  UNION ALL SELECT 'p_name', 'mixed'""")
def _q(t):
    return P.signature(t.part, [("email", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), ("brand", r"^Brand#[0-9]{1,2}$")])


@query("p27_cardinality_class", _each(CUST, """
  SELECT '{c}' AS "column", CASE WHEN d::DOUBLE / n >= 0.95 OR d >= greatest(1, n - 1) THEN 'unique' WHEN d::DOUBLE / n <= 0.05 THEN 'categorical'
    WHEN d <= greatest(20, floor(n * 0.05)) THEN 'categorical' ELSE 'continuous' END AS cardinality_class
  FROM (SELECT count(*) AS n, count(DISTINCT {c}) AS d FROM {t})""", "customer"))
def _q(t):
    return P.cardinality_class(P.counts(t.customer))


@query("p28_scan_coverage", """
  SELECT column_name AS "column", f AS facet, CASE WHEN f = 'type' THEN 'EVALUATED' WHEN column_type = 'VARCHAR' THEN 'EVALUATED' ELSE 'SKIPPED' END AS status
  FROM (DESCRIBE customer), (VALUES ('type'), ('pii')) v(f)""")
def _q(t):
    cols = P.types(t.customer).select("column")
    done = cols.select("column", F.lit("type").alias("facet"), F.lit("").alias("error")).unionByName(
        P.triage(t.customer).select("column", F.lit("pii").alias("facet"), F.lit("").alias("error")))
    return P.coverage(cols, ["type", "pii"], done).select("column", "facet", "status")

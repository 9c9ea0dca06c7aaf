"""Column profiles: one row per column, from one aggregate pass plus frequency tables built once.

Plain aggregates read a long form of the table without a shuffle of rows.  Statistics that need distinct values
group ``(column, value)`` first, so equal values combine inside each task.  Exact quantiles of unbounded numbers
use range blocks; quantiles of lengths use the small table of length counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions import text as X
from tablewarden.functions.columns import (col, count_if, lit_list, null_if_nan, numeric_columns, one_row, ratio, spread,
                                           scalar_columns, string_columns, unpivot)
from tablewarden.functions.dates import parse_any
from tablewarden.functions.ordered import exact_quantiles, order_steps, ranked_rows

# fixed values
PII_NAME_HINTS = ["name", "phone", "mobile", "email", "address", "national", "passport", "birth", "gender", "id",
                  "nid", "iban", "card", "الاسم", "رقم", "هاتف", "عنوان", "جنسية", "بريد", "هوية", "ميلاد", "جوال"]
IDENTIFIER_TOKENS = ["id", "zip", "postal", "phone", "mobile", "code", "nid", "national", "iban", "account", "ssn",
                     "sku", "serial"]
TEMPORAL_TOKENS = ["_at", "timestamp", "datetime", "created", "updated", "modified"]
NUMERIC_QUANTILES = [0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99]
UNICODE_CATEGORIES = ["Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Nd", "Nl", "No", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf",
                      "Po", "Sm", "Sc", "Sk", "So", "Zs", "Zl", "Zp", "Cc", "Cf"]

_EXTRA: dict[str, Callable[[Column], Column]] = {}


def register(name: str, agg: Callable[[Column], Column]) -> None:
    """Add an aggregate over a column's text values to every ``counts`` profile."""
    _EXTRA[name] = agg


def _digest(value: Column) -> Column:
    """Long values travel as a digest when only equality matters."""
    return F.when(F.length(value) > 64, F.sha2(value, 256)).otherwise(value)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): the frequency table most profiles share."""
    return unpivot(df, columns).where("value is not null").groupBy("column", "value") \
        .agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, distinct, duplicated rows, top count) without one Expand branch per column."""
    groups = unpivot(df, columns).where("value is not null").groupBy("column", _digest(F.col("value")).alias("k")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.max("n").alias("top_count"),
                                        F.sum("n").alias("counted"))


def _all_columns(columns: Sequence[str]) -> Column:
    return F.array(*[F.lit(c) for c in columns])


def counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row, null, empty, blank and distinct counts per column."""
    df = null_if_nan(df)
    names = list(columns or scalar_columns(df))
    v = F.col("value")
    base = unpivot(df, names).groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.count(v).alias("non_null"), F.count_if(v.isNull()).alias("nulls"),
        count_if(v == "").alias("empty_string"), count_if(v.rlike(r"^\s+$")).alias("whitespace_only"),
        *[fn(v).alias(n) for n, fn in _EXTRA.items()])
    out = base.join(distinct_counts(df, names), "column", "left")
    distinct = F.coalesce("distinct", F.lit(0))
    return out.select(
        "column", "rows", "non_null", "nulls", ratio(F.col("nulls"), F.col("rows")).alias("null_rate"),
        "empty_string", "whitespace_only", distinct.alias("distinct"),
        ratio(distinct, F.col("non_null")).alias("distinct_rate"),
        F.greatest(F.col("non_null") - distinct, F.lit(0)).alias("duplicate_rows"),
        ((F.col("non_null") > 0) & (distinct == F.col("non_null")) & (F.col("nulls") == 0)).alias("is_candidate_key"),
        ((F.col("non_null") > 0) & (distinct == 1)).alias("constant"), *_EXTRA)


def length(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Length statistics from the table of length counts (one row per distinct length)."""
    names = list(columns or string_columns(df))
    lens = unpivot(df, names).where("value is not null").groupBy("column", F.length("value").alias("len")) \
        .agg(F.count(F.lit(1)).alias("n"))
    total, first = F.sum("n"), F.sum(F.col("n") * F.col("len"))
    second = F.sum(F.col("n") * F.col("len").cast("double") * F.col("len"))
    q = F.expr("percentile(len, array(0.05D, 0.25D, 0.5D, 0.75D, 0.95D), n)")
    return lens.groupBy("column").agg(
        F.min("len").alias("min"), F.max("len").alias("max"), (first / total).alias("mean"),
        F.sqrt(F.greatest(second / total - (first / total) * (first / total), F.lit(0.0))).alias("stddev"),
        q.alias("q"), F.count(F.lit(1)).alias("distinct_lengths"),
        F.array_sort(F.collect_list(F.struct("len", "n"))).alias("histogram")).select(
        "column", "min", "max", "mean", F.col("q")[2].alias("median"), "stddev",
        *[F.col("q")[i].alias(n) for i, n in enumerate(["p05", "p25", "p50", "p75", "p95"])],
        "histogram", "distinct_lengths", (F.col("distinct_lengths") == 1).alias("fixed_width"))


def _top(groups: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent keys per column; the rank limit runs inside each task before the shuffle."""
    w = W.partitionBy("column").orderBy(F.col("n").desc(), F.col(key))
    return groups.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def masks(df: DataFrame, columns: Sequence[str] | None = None, top: int = 10) -> DataFrame:
    """Most frequent format masks: one row per (column, rank)."""
    names = list(columns or string_columns(df))
    groups = unpivot(df, names).where("value is not null") \
        .groupBy("column", X.profile_mask(F.col("value")).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    totals = groups.groupBy("column").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_masks"),
                                          F.max("n").alias("dominant"))
    return _top(groups, "mask", top).join(F.broadcast(totals), "column").select(     # totals: one row per column
        "column", "rank", "mask", "n", (F.col("n") / F.col("total")).alias("rate"), "distinct_masks",
        (F.col("dominant") / F.col("total")).alias("dominant_mask_rate"))


def charset(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Character composition and script shares."""
    names = list(columns or string_columns(df))
    v, folded = F.col("value"), X.fold_digits(F.col("value"))
    digits = folded.rlike(r"^\p{Nd}+$")
    latin, arabic = v.rlike("[A-Za-z]"), v.rlike(X.ARABIC_RANGE)
    hits = latin.cast("int") + arabic.cast("int") + digits.cast("int")

    def share(cond: Column) -> Column:
        return F.avg(cond.cast("int"))
    return unpivot(df, names).where("value is not null").groupBy("column").agg(
        share(digits).alias("digits_only_rate"), share(v.rlike(r"^\p{L}+$")).alias("alpha_only_rate"),
        share(v.rlike(r"^[\p{L}\p{N}]+$")).alias("alphanumeric_rate"),
        share(v.rlike(r"[^\p{L}\p{N}\s]")).alias("has_punctuation_rate"),
        share(v.rlike(r"\s")).alias("has_whitespace_rate"),
        share(digits & folded.rlike(r"^0.")).alias("leading_zeros_rate"),
        share((hits == 1) & latin).alias("latin"), share((hits == 1) & arabic).alias("arabic"),
        share((hits == 1) & digits).alias("numeric"), share(hits > 1).alias("mixed"))


def unicode_categories(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of each Unicode general category among all characters of a column."""
    names = list(columns or string_columns(df))
    sums = unpivot(df, names).where("value is not null").groupBy("column").agg(
        F.sum(F.length("value")).alias("chars"),
        *[F.sum(F.regexp_count("value", F.lit(rf"\p{{{c}}}"))).alias(c) for c in UNICODE_CATEGORIES])
    return sums.select("column", F.inline(F.filter(F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(c).alias("n"), ratio(F.col(c), F.col("chars")).alias("rate"))
        for c in UNICODE_CATEGORIES]), lambda s: s["n"] > 0)))


def _numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, x): numeric columns as they are, text columns parsed; x is null where a value does not parse."""
    numbers = set(numeric_columns(df))

    def as_number(c: str) -> Column:
        if c in numbers:
            return col(c).cast("double")
        t = F.trim(X.fold_digits(col(c).cast("string")))
        return F.when(~F.lower(t).isin("", "none", "null", "nan", "n/a", "na"), t.try_cast("double"))
    def finite(x: Column) -> Column:
        return F.when(F.abs(x) < F.lit(float("inf")), x)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), finite(as_number(c)).alias("x"), col(c).isNotNull().alias("filled")) for c in names])
    return df.select(F.inline(pairs)).where("filled")


def decimal_places(x: Column) -> Column:
    """Digits behind the point in the shortest decimal text of a double, whatever its size."""
    text = x.cast("string")
    digits = F.length(F.regexp_replace(F.regexp_extract(text, r"\.(\d+)", 1), "0+$", ""))
    power = F.coalesce(F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    return F.greatest(digits - power, F.lit(0))


def numeric(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 20,
            min_parse_rate: float = 0.5) -> DataFrame:
    """Numeric profile of every column whose values mostly parse as numbers."""
    names = list(columns or scalar_columns(df))
    long = _numbers(spread(null_if_nan(df).select(*[col(c) for c in names])), names)
    x = F.col("x")
    stats = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("non_null"), F.count(x).alias("parsed_count"), F.min(x).alias("min"),
        F.max(x).alias("max"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("stddev"),
        F.var_pop(x).alias("variance"), F.coalesce(F.nanvl(F.skewness(x), F.lit(0.0)), F.lit(0.0)).alias("skewness"),
        F.coalesce(F.nanvl(F.kurtosis(x), F.lit(0.0)), F.lit(0.0)).alias("kurtosis"),
        count_if(x == 0).alias("zero_count"), count_if(x < 0).alias("negative_count"),
        count_if(x == F.floor(x)).alias("integers")) \
        .where((F.col("parsed_count") > 0) & (F.col("parsed_count") / F.col("non_null") >= min_parse_rate))
    parsed = long.where("x is not null").join(F.broadcast(stats.select("column")), "column", "left_semi")
    quant = exact_quantiles(parsed, ["column"], "x", NUMERIC_QUANTILES, few_groups=True).drop("n")
    base = stats.join(quant, "column")                       # one row per column on both sides
    lo_f = F.col("quantiles")[2] - 1.5 * (F.col("quantiles")[4] - F.col("quantiles")[2])
    hi_f = F.col("quantiles")[4] + 1.5 * (F.col("quantiles")[4] - F.col("quantiles")[2])
    bounds = base.select("column", "min", "max", lo_f.alias("lo_f"), hi_f.alias("hi_f"))
    decimals = decimal_places(x)
    width = F.col("max") - F.col("min")
    bucket = F.when(width > 0, F.least(F.floor((x - F.col("min")) / width * bins), F.lit(bins - 1))).otherwise(0)
    cells = parsed.join(F.broadcast(bounds), "column").groupBy(
        "column", bucket.cast("int").alias("bin"), decimals.alias("decimals"),
        ((x < F.col("lo_f")) | (x > F.col("hi_f"))).alias("out")).agg(F.count(F.lit(1)).alias("n"))
    by_bin = cells.groupBy("column", "bin").agg(F.sum("n").alias("n")).groupBy("column").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    side = cells.groupBy("column").agg(
        F.sum(F.when(F.col("out"), F.col("n")).otherwise(0)).alias("outliers_iqr"),
        F.expr("percentile(decimals, 0.5D, n)").alias("decimal_places_median"))
    hist = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)),
                       lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0)))
    full = base.join(side, "column").join(by_bin, "column")
    return full.select(
        "column", "parsed_count", "min", "max", "sum", "mean", F.col("quantiles")[3].alias("median"), "stddev",
        "variance", *[F.col("quantiles")[i].alias(f"p{int(p * 100):02d}") for i, p in enumerate(NUMERIC_QUANTILES)],
        hist.alias("histogram"), "zero_count", "negative_count", "skewness", "kurtosis", "outliers_iqr",
        (F.col("outliers_iqr") / F.col("parsed_count")).alias("outlier_rate"),
        (F.col("integers") / F.col("parsed_count")).alias("integer_valued_rate"), "decimal_places_median")


def temporal(df: DataFrame, order_by: str, columns: Sequence[str] | None = None, now: str | None = None,
             min_parse_rate: float = 0.5) -> DataFrame:
    """Profile of every column whose values mostly parse as dates; ``order_by`` defines the row order."""
    names = list(columns or [c for c in scalar_columns(df) if c != order_by])
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value"),
                 (col(c).cast("timestamp") if isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
                  else parse_any(col(c).cast("string"))).alias("t")) for c in names])
    long = df.select(col(order_by).alias("_order"), F.inline(pairs)).where("value is not null")
    t = F.col("t")
    stats = long.groupBy("column").agg(
        F.count("value").alias("non_null"), F.count(t).alias("parsed"), F.min(t).alias("min"), F.max(t).alias("max"),
        count_if(t > (F.current_timestamp() if now is None else F.lit(now).cast("timestamp"))).alias("future_count"),
        F.max(F.second(t)).alias("sec"), F.max(F.hour(t) + F.minute(t)).alias("hm"),
        F.max((F.unix_micros(t) % 1000000)).alias("micros")) \
        .where((F.col("parsed") > 0) & (F.col("parsed") / F.col("non_null") >= min_parse_rate))
    parsed = long.where("t is not null").join(F.broadcast(stats.select("column")), "column", "left_semi")
    years = parsed.groupBy("column", F.year("t").alias("y")).agg(F.count(F.lit(1)).alias("n")).groupBy("column") \
        .agg(F.array_sort(F.collect_list(F.struct("y", "n"))).alias("by_year"))
    steps = order_steps(parsed, ["column"], "_order", "t").select("column", (F.col("ups") + F.col("sames")).alias("up"), (F.col("n") - 1).alias("steps"))
    grain = F.when((F.col("sec") > 0) | (F.col("micros") > 0), "second").when(F.col("hm") > 0, "minute").otherwise("day")
    return stats.join(years, "column").join(steps, "column").select(
        "column", "min", "max", F.floor((F.unix_seconds("max") - F.unix_seconds("min")) / 86400).alias("range_days"),
        ratio(F.col("up"), F.col("steps"), 1.0).alias("monotonic_rate"), "future_count",
        grain.alias("granularity"), "by_year")


def frequency(df: DataFrame, columns: Sequence[str] | None = None, top: int = 20,
              categorical_threshold: int = 50) -> DataFrame:
    """Top values, entropy and coverage per column."""
    names = list(columns or scalar_columns(df))
    groups = value_counts(df, names)
    n = F.col("n").cast("double")
    stats = groups.groupBy("column").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"),
                                         F.sum(n * F.log2(n)).alias("nlogn"))
    entropy = F.greatest(F.log2(F.col("total").cast("double")) - F.col("nlogn") / F.col("total"), F.lit(0.0))
    best = _top(groups, "value", top).groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("t"),
        F.sum(F.when(F.col("rank") <= 10, F.col("n"))).alias("top10"))
    return stats.join(best, "column").select(
        "column", "total", "distinct",
        F.transform("t", lambda e: F.struct(e["value"].alias("value"), e["n"].alias("n"))).alias("top_values"),
        entropy.alias("entropy_bits"),
        F.when(F.col("total") > 1, entropy / F.log2(F.col("total").cast("double"))).otherwise(0.0).alias("normalized_entropy"),
        (F.col("distinct") <= categorical_threshold).alias("is_categorical"),
        (F.col("top10") / F.col("total")).alias("coverage_of_top_10"))


def summarize(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The quick summary: bounded sketches only, so one pass over up to 200 columns at any size; min and max in the order of the column's own type."""
    names = list(columns or scalar_columns(df))

    def of(c: str) -> Column:
        v = col(c)
        x = v.cast("string").try_cast("double") if isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else v.try_cast("double")
        q = F.percentile_approx(x, [0.25, 0.5, 0.75], 10000)
        return F.struct(
            F.lit(c).alias("column"), F.min(v).cast("string").alias("min"), F.max(v).cast("string").alias("max"), F.approx_count_distinct(v).alias("approx_unique"),
            F.avg(x).alias("avg"), F.stddev_samp(x).alias("std"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.count(v).alias("count"),
            (100.0 * F.count_if(v.isNull()) / F.count(F.lit(1))).alias("null_percentage"))
    row = one_row(df, [of(c).alias(f"s{i}") for i, c in enumerate(names)], 200)
    return row.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(names))])))


def _name_is_identifier(name: Column) -> Column:
    low = F.lower(name)
    temporal_name = F.lit(False)
    for tok in TEMPORAL_TOKENS:
        temporal_name = temporal_name | low.contains(tok)
    temporal_name = temporal_name | low.rlike("_(date|time)$")
    parts = F.split(F.translate(low, "-", "_"), "_")
    return ~temporal_name & F.arrays_overlap(parts, lit_list(IDENTIFIER_TOKENS))


def metrics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Column metrics with content sniffing of text columns."""
    df = null_if_nan(df)
    names = list(columns or scalar_columns(df))
    types = {f.name: f.dataType for f in df.schema.fields}
    texts = [c for c in names if isinstance(types[c], T.StringType)]
    v, low = F.col("value"), F.lower(F.trim(F.col("value")))
    x, t = v.try_cast("double"), parse_any(v)

    def rate(cond: Column) -> Column:
        return F.coalesce(F.avg(F.when(v.isNotNull(), F.coalesce(cond, F.lit(False)).cast("int"))), F.lit(0.0))
    agg = unpivot(df, names).groupBy("column").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(v.isNull()).alias("null_count"),
        F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"),
        F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("stddev"),
        F.avg(F.length(v)).alias("avg_length"), rate(low.isin("true", "false", "yes", "no")).alias("b"),
        rate(x.isNotNull()).alias("num"), F.coalesce(F.every(F.when(x.isNotNull(), x == F.floor(x))), F.lit(False)).alias("whole"),
        rate(t.isNotNull()).alias("dt"), F.coalesce(F.some(F.date_format(t, "HH:mm:ss") != "00:00:00"), F.lit(False)).alias("time"),
        rate(low.isin("0", "1")).alias("flag"), F.coalesce(F.some(F.trim(v).rlike(r"^0\d+$")), F.lit(False)).alias("zeros"))
    is_text, is_num = F.col("column").isin(texts), F.col("column").isin(numeric_columns(df))
    open_ = is_text & ~(_name_is_identifier(F.col("column")) | F.col("zeros") | (F.col("flag") >= 0.95))
    as_bool = open_ & (F.col("b") >= 0.95)
    as_num = open_ & (F.col("num") >= 0.95)
    as_dt = open_ & ~as_num & ~as_bool & (F.col("dt") >= 0.95)
    dtype = F.element_at(F.create_map(*[y for c in names for y in (F.lit(c), F.lit(types[c].simpleString()))]), F.col("column"))
    shown = is_num | as_num
    return agg.join(distinct_counts(df, names).select("column", "distinct"), "column", "left").select(
        "column", dtype.alias("data_type"), "row_count", "null_count",
        F.round(ratio(F.col("null_count"), F.col("row_count")), 6).alias("null_proportion"),
        F.coalesce("distinct", F.lit(0)).alias("unique_count"),
        F.round(ratio(F.coalesce("distinct", F.lit(0)), F.col("row_count")), 6).alias("unique_proportion"),
        F.when(shown, F.col("lo")).alias("min_value"), F.when(shown, F.col("hi")).alias("max_value"),
        F.when(shown, F.col("mean")).alias("mean"), F.when(is_num, F.col("stddev")).alias("stddev"),
        F.when(is_text, F.col("avg_length")).alias("avg_length"), as_num.alias("coerced_numeric"),
        (as_num & F.col("whole")).alias("coerced_integer"), as_bool.alias("coerced_boolean"),
        as_dt.alias("coerced_datetime"), (as_dt & F.col("time")).alias("has_time_component"))


def type_hints(metric_rows: DataFrame, suppress: Sequence[str] = ()) -> DataFrame:
    """Logical type of each column from its metrics; triaged identifier columns stay text."""
    d = F.col("data_type")
    logical = (F.when(F.col("column").isin(list(suppress)), "string")
               .when(d.rlike("int|long|short"), "integer").when(d.rlike("double|float|decimal"), "number")
               .when(F.col("coerced_boolean"), "boolean")
               .when(F.col("coerced_datetime"), F.when(F.col("has_time_component"), "timestamp").otherwise("date"))
               .when(F.col("coerced_numeric"), F.when(F.col("coerced_integer"), "integer").otherwise("number"))
               .when(d == "boolean", "boolean").when(d == "date", "date").when(d.startswith("timestamp"), "timestamp")
               .otherwise("string"))
    return metric_rows.select("column", logical.alias("logical_type"), d.alias("physical_type"))


def suppressed_types(triage_rows: DataFrame) -> DataFrame:
    """Columns whose sniffed type stays text because triage sends them to detection."""
    return triage_rows.where(F.col("send_to_detector") & (
        _name_is_identifier(F.col("column")) | (F.col("name_hint_score") > 0))).select("column")


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    return _top(value_counts(df, list(columns or scalar_columns(df))), "value", k)


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """Equal-width histogram (right-closed buckets), empty buckets included."""
    names = list(columns or numeric_columns(df))
    long = _numbers(null_if_nan(df), names).where("x is not null")
    b = long.groupBy("column").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("rows"))
    width = (F.col("hi") - F.col("lo")) / bins
    bucket = F.when(width > 0, F.greatest(F.ceil((F.col("x") - F.col("lo")) / width) - 1, F.lit(0))).otherwise(0)
    got = long.join(F.broadcast(b), "column").groupBy(
        "column", F.least(bucket, F.lit(bins - 1)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    frame = b.select("column", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bucket"))
    return frame.join(got, ["column", "bucket"], "left").select(
        "column", "bucket", (F.col("lo") + width * F.col("bucket")).alias("bucket_lo"),
        (F.col("lo") + width * (F.col("bucket") + 1)).alias("bucket_hi"), F.coalesce("n", F.lit(0)).alias("n"))


def script_share(df: DataFrame, columns: Sequence[str] | None = None, pattern: str = X.ARABIC_RANGE) -> DataFrame:
    names = list(columns or string_columns(df))
    return unpivot(df, names).groupBy("column").agg(
        F.coalesce(F.avg(F.col("value").rlike(pattern).cast("int")), F.lit(0.0)).alias("share"))


def triage(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.30) -> DataFrame:
    """How likely a text column holds personal data: name, cardinality, length, nulls, Arabic script."""
    names = list(columns or string_columns(df))
    v = F.col("value")
    base = unpivot(df, names).groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(v.isNull().cast("int")).alias("null_rate"),
        F.coalesce(F.avg(F.length(v)), F.lit(0.0)).alias("avg_len"),
        F.coalesce(F.avg(v.rlike(X.ARABIC_RANGE).cast("int")), F.lit(0.0)).alias("arabic")) \
        .join(distinct_counts(df, names).select("column", "distinct"), "column", "left")
    card = F.coalesce("distinct", F.lit(0)) / F.col("rows")
    n = F.col("avg_len")
    card_score = F.when(card >= 0.10, F.least(card * 2, F.lit(1.0))).when(card < 0.01, 0.05).otherwise(card * 5)
    len_score = F.when((n >= 5) & (n <= 80), F.least((n - 5) / 75, F.lit(1.0))).when(n < 5, 0.05) \
        .otherwise(F.greatest(1.0 - (n - 80) / 200, F.lit(0.2)))
    null_score = F.greatest(F.lit(0.0), 1.0 - F.col("null_rate") * 2)
    hint = F.exists(lit_list(PII_NAME_HINTS), lambda h: F.contains(F.lower("column"), h)).cast("double")
    arabic_score = F.least(F.col("arabic") * 5, F.lit(1.0))
    score = card_score * 0.20 + len_score * 0.20 + null_score * 0.10 + hint * 0.40 + arabic_score * 0.10
    return base.select("column", F.round(card, 4).alias("cardinality_ratio"), F.round(n, 2).alias("avg_value_length"),
                       F.round("null_rate", 4).alias("null_rate"), hint.alias("name_hint_score"),
                       F.round("arabic", 4).alias("arabic_fraction"), F.round(score, 4).alias("triage_score"),
                       (score >= threshold).alias("send_to_detector"))


def full_stats(df: DataFrame, minmax_columns: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """Count, nulls, distinct and (for the allowed columns) min / max of every column in one pass."""
    names = scalar_columns(df)
    base = one_row(df, [a for i, c in enumerate(names) for a in (
        F.count(col(c)).alias(f"n{i}"), F.count(F.lit(1)).alias(f"r{i}"),
        *([] if exact else [F.approx_count_distinct(col(c)).alias(f"d{i}")]),
        *([F.min(col(c)).cast("string").alias(f"lo{i}"), F.max(col(c)).cast("string").alias(f"hi{i}")]
          if c in minmax_columns else []))])
    rows = base.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"r{i}").alias("count"), (F.col(f"r{i}") - F.col(f"n{i}")).alias("nulls"),
        (F.lit(None).cast("bigint") if exact else F.col(f"d{i}")).alias("distinct"),
        (F.col(f"lo{i}") if c in minmax_columns else F.lit(None).cast("string")).alias("min"),
        (F.col(f"hi{i}") if c in minmax_columns else F.lit(None).cast("string")).alias("max"))
        for i, c in enumerate(names)])))
    if not exact:
        return rows
    return rows.drop("distinct").join(distinct_counts(df, names).select("column", "distinct"), "column", "left") \
        .select("column", "count", "nulls", F.coalesce("distinct", F.lit(0)).alias("distinct"), "min", "max")


def fill_gaps(df: DataFrame, catalog_stats: DataFrame, exact: bool = True) -> DataFrame:
    """Compute only what the catalog lacks: one aggregate over just the missing or stale columns.

    ``catalog_stats``: (column, ndv, num_nulls, min, max, fresh); one row per column, read on the driver to
    decide which columns the scan must read at all.
    """
    known = {r["column"] for r in catalog_stats.where("fresh and (ndv is not null or num_nulls is not null)")
             .select("column").collect()}
    need = [c for c in scalar_columns(df) if c not in known]
    kept = catalog_stats.where(F.col("column").isin(list(known))).select(
        "column", "ndv", "num_nulls", "min", "max", F.lit("catalog").alias("source"))
    if not need:
        return kept
    live = full_stats(df.select(*[col(c) for c in need]), need, exact).select(
        "column", F.col("distinct").alias("ndv"), F.col("nulls").alias("num_nulls"), "min", "max",
        F.lit("query").alias("source"))
    return kept.unionByName(live)


# --- relationships ---------------------------------------------------------------------------------------

def duplicate_rows(df: DataFrame, exact: bool = True) -> DataFrame:
    """Rows minus distinct rows; rows travel as a digest."""
    key = F.sha2(F.to_json(F.struct(*[col(c) for c in df.columns])), 256)
    if not exact:
        return df.select(key.alias("k")).agg(
            F.count(F.lit(1)).alias("rows"),
            F.greatest(F.count(F.lit(1)) - F.approx_count_distinct("k", 0.01), F.lit(0)).alias("duplicate_rows"))
    return df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("n") - F.count(F.lit(1)), F.lit(0)).alias("duplicate_rows"))


def constant_columns(df: DataFrame, threshold: float = 0.99) -> DataFrame:
    """constant / near-constant columns by the share of their most frequent value over all rows."""
    names = scalar_columns(df)
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    share = F.col("top_count") / F.col("rows")
    kind = F.when(F.col("distinct") <= 1, "constant").when(share >= threshold, "near_constant").otherwise("varied")
    return distinct_counts(df, names).crossJoin(F.broadcast(total)).select(
        "column", "distinct", share.alias("top_share"), kind.alias("kind"))


def _pairs_long(row: DataFrame, names: Sequence[str]) -> DataFrame:
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r"))
        for i, (a, b) in enumerate(combinations(names, 2))])))


def corr(df: DataFrame, method: str = "pearson", columns: Sequence[str] | None = None) -> DataFrame:
    """All column pairs in one aggregate, long form (a, b, r)."""
    df = null_if_nan(df)
    names = list(columns or numeric_columns(df))
    work = df.select(*[col(c).cast("double").alias(c) for c in names])
    if method == "spearman":
        work = ranked_rows(work, names)
    def pair(a: str, b: str) -> Column:
        x, y = F.when(col(b).isNotNull(), col(a)), F.when(col(a).isNotNull(), col(b))     # rows where both are known
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    aggs = [pair(a, b).alias(f"c{i}") for i, (a, b) in enumerate(combinations(names, 2))]
    return _pairs_long(one_row(work, aggs), names)


def redundant_pairs(corr_rows: DataFrame, threshold: float = 0.95) -> DataFrame:
    return corr_rows.where(F.abs("r") >= threshold)


def relationship_flags(corr_rows: DataFrame, constants: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Per column: redundant_with, constant, near_constant."""
    pairs = redundant_pairs(corr_rows, threshold)
    both = pairs.select(F.col("a").alias("column"), F.col("b").alias("other")) \
        .unionByName(pairs.select(F.col("b").alias("column"), F.col("a").alias("other")))
    partners = both.groupBy("column").agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("redundant_with"))
    return constants.select("column", "kind").join(partners, "column", "left").select(
        "column", F.coalesce("redundant_with", F.lit("")).alias("redundant_with"),
        (F.col("kind") == "constant").alias("is_constant"), (F.col("kind") == "near_constant").alias("is_near_constant"))


# --- schema ----------------------------------------------------------------------------------------------

def logical_type(dtype: T.DataType) -> str:
    name = dtype.simpleString().lower()
    if name.startswith("array<"):
        return "array"
    if name.startswith(("map<", "struct<")):
        return "object"
    for token, logical in (("decimal", "decimal"), ("double", "number"), ("float", "number"), ("interval", "interval"),
                           ("int", "integer"), ("timestamp", "timestamp"), ("date", "date"), ("bool", "boolean")):
        if token in name:
            return logical
    return "string"


def types(df: DataFrame) -> DataFrame:
    """(column, ordinal, physical, logical) from the schema; no job over the data."""
    rows = [F.struct(F.lit(f.name).alias("column"), F.lit(i).alias("ordinal"),
                     F.lit(f.dataType.simpleString()).alias("physical_type"),
                     F.lit(logical_type(f.dataType)).alias("logical_type"), F.lit(not f.nullable).alias("required"))
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def contract_columns(df: DataFrame, table: str) -> DataFrame:
    """The base contract rows of a table."""
    return types(df).select(F.lit(table).alias("table_name"), F.col("column").alias("column_name"), "ordinal",
                            "logical_type", "physical_type", "required")


# --- fingerprints ----------------------------------------------------------------------------------------

def fingerprint(df: DataFrame, pii_columns: Sequence[str] = (), columns: Sequence[str] | None = None,
                k_anonymity: int = 20) -> DataFrame:
    """Value-free description of every column: lengths, character classes, distinct ratio, masks."""
    df = null_if_nan(df)
    names = list(columns or scalar_columns(df))
    v, n_len = F.col("value"), F.length("value")
    x = v.try_cast("double")

    def chars(pattern: str) -> Column:
        return F.coalesce(F.sum(F.regexp_count(v, F.lit(pattern))), F.lit(0))
    long = unpivot(df, names)
    base = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.count(v).alias("n"), F.count_if(v.isNull()).alias("nulls"),
        count_if(v == "").alias("empty"), F.coalesce(F.avg(n_len), F.lit(0.0)).alias("len_mean"),
        F.coalesce(F.stddev_samp(n_len), F.lit(0.0)).alias("len_std"), F.coalesce(F.min(n_len), F.lit(0)).alias("len_min"),
        F.coalesce(F.max(n_len), F.lit(0)).alias("len_max"), F.coalesce(F.sum(n_len), F.lit(0)).alias("chars"),
        chars(r"\p{Nd}").alias("digit"), chars("[A-Za-z]").alias("alpha"), chars("[A-Z]").alias("upper"),
        chars(r"\s").alias("space"), chars(r"(?![\p{Nd}])" + X.ARABIC_RANGE).alias("arabic"),
        F.coalesce(F.avg(F.when(v.isNotNull(), F.size(F.filter(F.split(F.trim(v), r"\s+"), lambda t: t != "")))),
                   F.lit(0.0)).alias("token_count_mean"),
        F.min(x).alias("num_min"), F.max(x).alias("num_max"), F.avg(x).alias("num_mean"), F.stddev_samp(x).alias("num_std"))
    lens = long.where("value is not null").groupBy("column", n_len.alias("len")).agg(F.count(F.lit(1)).alias("c"))
    cd = F.col("c").cast("double")
    length_stats = lens.groupBy("column").agg(
        F.expr("percentile(len, array(0.5D, 0.9D), c)").alias("lq"),
        F.round(F.log2(F.sum(cd)) - F.sum(cd * F.log2(cd)) / F.sum(cd), 6).alias("len_entropy"))
    mask_counts = long.where("value is not null").groupBy(
        "column", X.fingerprint_mask(v).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    # folding rare masks into "other" first keeps at most n/k kept masks; only ten are kept per column
    folded = mask_counts.groupBy("column", F.when(F.col("n") < k_anonymity, "other").otherwise(F.col("mask")).alias("mask")) \
        .agg(F.sum("n").alias("n"), F.max((F.col("n") < k_anonymity).cast("int")).alias("rare"))
    w = W.partitionBy("column").orderBy("rare", F.col("n").desc(), "mask")
    top = folded.withColumn("rank", F.row_number().over(w)).where("rank <= 10").groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("rank", "mask", "n"))).alias("masks"))
    pii = F.col("column").isin(list(pii_columns)) if pii_columns else F.lit(False)
    shown = F.col("column").isin(numeric_columns(df)) & ~pii
    distinct = F.coalesce("distinct", F.lit(0))
    ratio_ = F.least(distinct / F.greatest(F.col("rows"), F.lit(1)), F.lit(1.0))
    out = base.join(length_stats, "column", "left").join(top, "column", "left") \
        .join(distinct_counts(df, names).select("column", "distinct"), "column", "left")
    punct = F.col("chars") - F.col("digit") - F.col("alpha") - F.col("space") - F.col("arabic")

    def frac(c: Column) -> Column:
        return F.round(ratio(c, F.col("chars")), 6)
    return out.select(
        "column", "len_min", "len_max", F.round("len_mean", 4).alias("len_mean"), F.round("len_std", 4).alias("len_std"),
        F.coalesce(F.floor(F.col("lq")[0]), F.lit(0)).alias("len_p50"),
        F.coalesce(F.floor(F.col("lq")[1]), F.lit(0)).alias("len_p90"),
        frac(F.col("digit")).alias("frac_digit"), frac(F.col("alpha")).alias("frac_alpha"),
        frac(F.col("upper")).alias("frac_upper"), frac(F.col("space")).alias("frac_space"),
        frac(punct).alias("frac_punct"), frac(F.col("arabic")).alias("frac_arabic"),
        F.round(ratio_, 6).alias("distinct_ratio"),
        ((distinct >= F.col("rows")) & (F.col("rows") > 0) & (ratio_ >= 0.999)).alias("is_unique"),
        (distinct <= 1).alias("is_constant"), F.round(ratio(F.col("nulls"), F.col("rows")), 6).alias("null_rate"),
        (F.col("nulls") > 0).alias("has_nulls"), F.round(ratio(F.col("empty"), F.col("n")), 6).alias("empty_rate"),
        F.round("token_count_mean", 4).alias("token_count_mean"),
        F.coalesce("len_entropy", F.lit(0.0)).alias("len_entropy"),
        F.coalesce(F.transform("masks", lambda m: F.struct(
            m["mask"].alias("mask"), F.round(m["n"] / F.col("n"), 4).alias("share"))),
            F.array().cast("array<struct<mask:string,share:double>>")).alias("pattern_masks"),
        *[F.when(shown, F.col(c)).alias(c) for c in ("num_min", "num_max", "num_mean", "num_std")],
        pii.alias("is_pii_reduced"), F.lit("full").alias("stats_source"), F.col("rows").alias("sample_size"))


VECTOR_SIZE, MASK_SLOTS = 64, 16


def fingerprint_vector(fp: DataFrame) -> DataFrame:
    """Fingerprint rows → unit vectors: 23 scalars, 4 empty slots, 16 hashed mask slots, padding."""
    def scaled(c: str, hi: float) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c).cast("double") / hi))

    def flag(c: str) -> Column:
        return F.col(c).cast("int").cast("double")
    scalars = [scaled("len_mean", 200), scaled("len_std", 50), scaled("len_p50", 200), scaled("len_p90", 200),
               scaled("len_min", 200), scaled("len_max", 200), *[F.col(c) for c in (
                   "frac_digit", "frac_alpha", "frac_upper", "frac_space", "frac_punct", "frac_arabic", "distinct_ratio")],
               flag("is_unique"), flag("is_constant"), F.col("null_rate"), flag("has_nulls"), F.col("empty_rate"),
               scaled("token_count_mean", 20), scaled("len_entropy", 8), flag("is_pii_reduced"),
               (F.col("stats_source") == "full").cast("int").cast("double"), scaled("sample_size", 10000)]
    slot = lambda m: F.when(m == "other", MASK_SLOTS - 1).otherwise(
        F.conv(F.substring(F.md5(m), 1, 8), 16, 10).cast("bigint") % MASK_SLOTS)
    bag = F.transform(F.sequence(F.lit(0), F.lit(MASK_SLOTS - 1)), lambda i: F.aggregate(
        F.filter("pattern_masks", lambda m: slot(m["mask"]) == i), F.lit(0.0), lambda acc, m: acc + m["share"]))
    head = F.array(*[F.coalesce(s.cast("double"), F.lit(0.0)) for s in scalars], *[F.lit(0.0)] * 4)
    raw = F.concat(head, bag, F.array_repeat(F.lit(0.0), VECTOR_SIZE - len(scalars) - 4 - MASK_SLOTS))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x))
    return fp.withColumn("raw", raw).withColumn("norm", norm).select(
        "column", F.transform("raw", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(x)).alias("vector"))


def signature(df: DataFrame, patterns: Sequence[tuple[str, str]], columns: Sequence[str] | None = None) -> DataFrame:
    """Name of the first pattern every value matches, else the single shape, else mixed / empty."""
    names = list(columns or string_columns(df))
    v = F.trim(F.col("value"))
    shape = X.memory_mask(v)
    agg = unpivot(df, names).groupBy("column").agg(
        count_if(v != "").alias("n"),
        *[F.coalesce(F.every(F.when(v != "", v.rlike(p))), F.lit(False)).alias(f"p{i}") for i, (_, p) in enumerate(patterns)],
        F.min(F.when(v != "", shape)).alias("lo"), F.max(F.when(v != "", shape)).alias("hi"))
    name = F.when(F.col("n") == 0, "empty")
    for i, (label, _) in enumerate(patterns):
        name = name.when(F.col(f"p{i}"), label)
    return agg.select("column", name.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("mixed").alias("signature"))


def cardinality_class(count_rows: DataFrame) -> DataFrame:
    """unique / categorical / continuous from (rows, distinct)."""
    r = ratio(F.col("distinct"), F.col("rows"))
    kind = (F.when((r >= 0.95) | (F.col("distinct") >= F.greatest(F.lit(1), F.col("rows") - 1)), "unique")
            .when(r <= 0.05, "categorical")
            .when(F.col("distinct") <= F.greatest(F.lit(20), F.floor(F.col("rows") * 0.05)), "categorical")
            .otherwise("continuous"))
    return count_rows.select("column", kind.alias("cardinality_class"))


def coverage(columns: DataFrame, facets: Sequence[str], done: DataFrame) -> DataFrame:
    """One row per (column, facet): EVALUATED, SKIPPED or ERROR with a reason.

    ``done``: (column, facet, error) for what a scan produced; both sides are schema-sized.
    """
    grid = columns.select("column", F.explode(_all_columns(facets)).alias("facet"))
    return grid.join(done.select("column", "facet", F.coalesce("error", F.lit("")).alias("error"), F.lit(True).alias("seen")),
                     ["column", "facet"], "left").select(
        "column", "facet",
        F.when(F.col("seen").isNull(), "SKIPPED").when(F.col("error") != "", "ERROR").otherwise("EVALUATED").alias("status"),
        F.when(F.col("seen").isNull(), "column not scanned").otherwise(F.col("error")).alias("reason"))

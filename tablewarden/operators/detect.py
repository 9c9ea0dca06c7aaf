"""Personal-data discovery on columns: pattern and checksum rates for a whole table in one aggregate.

The table is scanned as a whole (``sample`` is an option of the caller, not a default).  What comes out is small:
one row per (column, pattern) or per column, and all later steps are joins and expressions over those rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tablewarden.functions import checks as C
from tablewarden.functions import pattern_values as V
from tablewarden.functions import text as X
from tablewarden.functions.columns import (col, computed_once, count_if, lit_list, one_row, ratio, spread, string_columns,
                                           unpivot)
from tablewarden.functions.ordered import order_steps

FIELDS = ["pattern_name", "entity_type", "group", "script", "validator", "collision_group", "score",
          "validated_score", "hints", "regex"]
# fixed values
ARABIC_LIMIT, STRUCTURED_LIMIT, CONTEXT_BOOST = 0.05, 60, 0.40


# --- catalogue -------------------------------------------------------------------------------------------

def catalog(add: Sequence[tuple] = (), disable: Sequence[str] = (), enable: Sequence[str] = ()) -> list[dict[str, Any]]:
    """Active patterns after overrides."""
    off = (V.INACTIVE - set(enable)) | set(disable)
    return [dict(zip(FIELDS, p)) for p in [*V.PATTERNS, *add] if p[0] not in off]


def java_regex(p: dict[str, Any]) -> str:
    """Word boundaries follow Unicode inside text, ASCII classes stay ASCII in whole cells."""
    return ("(?U)" if p["group"] == "free_text" or p["script"] in ("both", "arabic") else "") + p["regex"]


def may_match(p: dict[str, Any], text: Column, lowered: Column) -> Column:
    """A cheap necessary condition of a free-text pattern, so that most texts never meet its full expression."""
    pieces, digits = V.NEEDS_ANY.get(p["pattern_name"]), V.NEEDS_DIGITS.get(p["pattern_name"])
    if pieces:
        hit = F.lit(False)
        for piece in pieces:
            hit = hit | lowered.contains(piece)
        return hit
    return text.rlike(rf"\p{{Nd}}{{{digits}}}") if digits else F.lit(True)


def catalog_rows(spark, patterns: Sequence[dict[str, Any]] | None = None) -> DataFrame:
    """The catalogue as rows; its size is the catalogue's (about a hundred rows), so it may be broadcast."""
    rows = [tuple(p[f] for f in FIELDS) for p in patterns or catalog()]
    return spark.createDataFrame(rows, "pattern_name string, entity_type string, `group` string, script string, validator string, "
                                       "collision_group string, score double, validated_score double, hints string, regex string")


# --- pattern rates ---------------------------------------------------------------------------------------

def column_shape(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean length and Arabic share per column: decides which pattern group applies."""
    v = F.col("value")
    return unpivot(df, list(columns or string_columns(df))).groupBy("column").agg(
        F.count(v).alias("n"), F.coalesce(F.avg(F.length(v)), F.lit(0.0)).alias("mean_length"),
        F.coalesce(F.avg(v.rlike(X.ARABIC_RANGE).cast("int")), F.lit(0.0)).alias("arabic_share"))


def longest_digits(text: Column) -> Column:
    """Length of the longest run of digits: one pass that stands for the digit conditions of all patterns."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"\p{Nd}+"), F.lit(0)), F.length)), F.lit(0))


def anchored(regex: str) -> bool:
    """Whether an expression begins with ``^`` for all of it: no alternative stands outside brackets."""
    if not re.match(r"(?:\(\?[A-Za-z]+\))*\^", regex):
        return False
    bare = re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", "", regex, flags=re.S)
    depth = 0
    for c in bare:
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            return False
    return True


def all_matches(text: Column, patterns: Sequence[tuple[int, str]]) -> Column:
    """The numbers of all patterns that match somewhere in a short text, as one compiled expression.

    At the start of the text every pattern is an optional look-ahead; where it holds, the text's first character lands in the pattern's own group.  The
    whole text is replaced by these groups, one place for each pattern, and the places that are filled name the matches.
    """
    mark = "\x02"

    def seen(i: int, regex: str) -> str:
        ahead = regex if anchored(regex) else rf"[\s\S]*?(?:{regex})"
        return rf"(?:(?={ahead})(?=(?<g{i}>[\s\S])))?"
    whole = r"\A" + "".join(seen(i, r) for i, r in patterns) + r"[\s\S]+"
    places = F.split(F.regexp_replace(F.translate(text, mark, " "), F.lit(whole), F.lit(mark.join(f"${{g{i}}}" for i, _ in patterns))), mark, -1)
    numbers = F.array(*[F.lit(i) for i, _ in patterns])
    return F.when(text != "", F.filter(F.zip_with(numbers, places, lambda i, x: F.when(x != "", i)), lambda i: i.isNotNull()))


def _short_matches(cells: DataFrame, picked: Sequence[tuple[int, dict[str, Any]]]) -> Column:
    """Numbers of the structured patterns of a cell: by its raw text, or by its canonical phone forms."""
    found = all_matches(F.col("value"), [(i, java_regex(p)) for i, p in picked])
    phones = [(i, java_regex(p)) for i, p in picked if p["entity_type"] == "PHONE_NUMBER"]
    if phones:
        national = F.concat(F.lit("0"), F.substring("canon", 4, 10))
        found = F.when(F.col("canon").isNull(), found).otherwise(F.array_union(found, F.array_union(all_matches(F.col("canon"), phones), all_matches(national, phones))))
    arabic = [i for i, p in picked if p["script"] == "arabic"]
    return F.filter(found, lambda i: F.col("arabic") | ~i.isin(arabic)) if arabic else found


def _matched(cells: DataFrame, picked: Sequence[tuple[int, dict[str, Any]]], group: str) -> DataFrame:
    """(column, total, i, n, valid): the patterns each cell matches; a cell stands for ``n`` equal ones."""
    v, codes = F.col("value"), []
    if group == "structured":
        numbers = _short_matches(cells, picked)
    else:
        for i, p in picked:
            digits = V.NEEDS_DIGITS.get(p["pattern_name"])
            possible = F.col("digits") >= digits if digits and p["pattern_name"] not in V.NEEDS_ANY else may_match(p, v, F.col("lowered"))
            if p["script"] == "arabic":
                possible = F.col("arabic") & possible
            codes.append(F.when(possible & v.rlike(java_regex(p)), F.lit(i)))
        numbers = F.array_compact(F.array(*codes))
    hits = cells.select("column", "total", "n", v, F.explode(numbers).alias("i"))
    # only matches meet a validator, and each kind of it stands once in the plan, whatever number of patterns asks for it
    i, valid = F.col("i"), F.lit(True)
    kinds: dict[str, list[tuple[int, dict[str, Any]]]] = {}
    for k, p in picked:
        if p["validator"]:
            kinds.setdefault(p["validator"], []).append((k, p))
    for kind, members in kinds.items():
        check_ = C.VALIDATORS[kind]
        if group == "structured":
            valid = F.when(i.isin([k for k, _ in members]), check_(v)).otherwise(valid)
        else:      # inside text every match is validated, and one valid match is enough
            for k, p in members:
                valid = F.when(i == k, F.exists(F.regexp_extract_all(v, F.lit(java_regex(p)), F.lit(0)), check_)).otherwise(valid)
    return hits.select("column", "total", "i", "n", F.coalesce(valid, F.lit(False)).alias("valid"))


def regex_rates(df: DataFrame, columns: Sequence[str] | None = None, patterns: Sequence[dict[str, Any]] | None = None) -> DataFrame:
    """(column, pattern, matches, rate, score): all patterns of all columns.

    Which pattern group a column gets follows from its mean length and script; that is one small row per column inside the plan, so building runs
    no job.  Short columns are looked at once per different value.  A cell matches by its raw text or its canonical phone forms; a validator
    keeps or drops the match.  Each cell yields only the numbers of the patterns it matched, and those are counted before the shuffle.
    """
    names = list(columns or string_columns(df))
    shape = column_shape(df, names).select("column", F.col("n").alias("total"), (F.col("mean_length") < STRUCTURED_LIMIT).alias("short"), (F.col("arabic_share") >= ARABIC_LIMIT).alias("arabic"))
    chosen = list(patterns or catalog())
    picked = {g: [(i, p) for i, p in enumerate(chosen) if p["group"] == g] for g in ("structured", "free_text")}
    # the shape has one row per column
    long = unpivot(df, names).where("value is not null").where(~F.upper("value").isin("NONE", "NAN", "N/A", "")).join(F.broadcast(shape), "column")
    found = []
    if picked["structured"]:
        counted = long.where("short").groupBy("column", "total", "arabic", "value").agg(F.count(F.lit(1)).alias("n"))
        found.append(_matched(computed_once(spread(counted), canon=C.msisdn_egypt(F.col("value"))), picked["structured"], "structured"))
    if picked["free_text"]:
        texts = spread(long.where("not short")).withColumn("n", F.lit(1).cast("bigint"))
        found.append(_matched(computed_once(texts, lowered=F.lower("value"), digits=longest_digits(F.col("value"))), picked["free_text"], "free_text"))
    hits = found[0] if found else df.sparkSession.createDataFrame([], "column string, total bigint, i int, n bigint, valid boolean")
    for more in found[1:]:
        hits = hits.unionByName(more)
    sums = hits.groupBy("column", "total", "i").agg(F.sum("n").alias("regex_matches"), F.coalesce(F.sum(F.when(F.col("valid"), F.col("n"))), F.lit(0)).alias("matches"))
    rows = [(i, p["pattern_name"], p["entity_type"], p["collision_group"], p["validator"],
             float(p["validated_score"] or p["score"]) if p["validator"] else float(p["score"])) for i, p in enumerate(chosen)]
    meta = df.sparkSession.createDataFrame(rows, "i int, pattern_name string, entity_type string, collision_group string, validator string, score double")
    # the pattern table has as many rows as the catalogue
    return sums.join(F.broadcast(meta), "i").where("matches > 0").select(
        "column", "pattern_name", "entity_type", "collision_group", "validator", "regex_matches", "matches", "total", "score",
        F.round(ratio(F.col("matches"), F.col("total")), 4).alias("match_rate"))


def check(df: DataFrame, column: str, kind: str, name: str | None = None) -> DataFrame:
    """Every row with a struct (valid, reason, parsed parts…) for one column."""
    c = col(column)
    out = C.STAGED[kind](c) if kind in C.STAGED else F.struct(C.VALIDATORS[kind](c).alias("valid"))
    return df.withColumn(name or f"{column}_{kind}", out)


def check_rates(df: DataFrame, kinds: dict[str, Sequence[str]]) -> DataFrame:
    """(column, kind, checked, valid, rate) of all columns and kinds in one aggregate."""
    aggs, rows = [], []
    for c, ks in kinds.items():
        usable = ~X.is_nullish(col(c).cast("string"))
        for k in ks:
            i = len(rows)
            aggs += [count_if(usable).alias(f"n{i}"), count_if(usable & C.VALIDATORS[k](col(c).cast("string"))).alias(f"v{i}")]
            rows.append(F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(f"n{i}").alias("checked"),
                                 F.col(f"v{i}").alias("valid"), ratio(F.col(f"v{i}"), F.col(f"n{i}")).alias("rate")))
    return one_row(df, aggs).select(F.inline(F.array(*rows)))


def nid_funnel(df: DataFrame, column: str, as_of: str | None = None) -> DataFrame:
    """How many values pass each stage."""
    r = df.where(~X.is_nullish(col(column))).select(C.egypt_nid(col(column), as_of).alias("r")).select("r.*")
    stages = ["normalize", "format", "calendar", "governorate", "plausibility"]
    passed = [count_if(~F.col("reason").isin(stages[:i + 1])).alias(s) for i, s in enumerate(stages)]
    return r.agg(F.count(F.lit(1)).alias("non_null"), *passed, count_if(F.col("valid") & F.col("check_digit_ok")).alias("checkdigit"))


def nid_rates(df: DataFrame, column: str, order_by: str, as_of: str | None = None) -> DataFrame:
    """Rates over values of the right format; ``order_by`` defines the row order of the monotonic rate."""
    r = df.where(~X.is_nullish(col(column))).select(col(order_by).alias("_o"), C.egypt_nid(col(column), as_of).alias("r")) \
        .select("_o", "r.*").where(~F.col("reason").isin("normalize", "format"))
    age = F.datediff(C.day(as_of), "birth_date")
    # ages in days are at most a few ten thousand values
    ages = r.where("valid").groupBy(age.alias("d")).agg(F.count(F.lit(1)).alias("n")) \
        .agg(F.expr("percentile(d, array(0.05D, 0.95D), n)").alias("q"))
    unique = r.groupBy("digits").agg(F.count(F.lit(1)).alias("n")).agg(
        ratio(F.count(F.lit(1)), F.sum("n"), None).alias("nid_unique_rate"))
    steps = order_steps(r.select("_o", "digits"), [], "_o", "digits").select(ratio(F.col("ups") + F.col("sames"), F.col("n") - 1).alias("nid_monotonic_rate"))
    base = r.agg(
        F.count(F.lit(1)).alias("nid_checked"), count_if(F.col("valid")).alias("nid_valid"),
        ratio(count_if(F.col("valid")), F.count(F.lit(1))).alias("nid_valid_rate"),
        ratio(count_if(F.col("check_digit_ok") & F.col("reason").isin("")), count_if(F.col("reason") == ""), None).alias("nid_checkdigit_rate"),
        F.count_distinct(F.when(F.col("valid"), F.col("gov_code"))).alias("nid_gov_distinct"))
    return base.crossJoin(ages.select((F.col("q")[0] / 365.25).alias("nid_age_p05"), (F.col("q")[1] / 365.25).alias("nid_age_p95"))) \
        .crossJoin(unique).crossJoin(steps)          # one row each


def imei_rates(df: DataFrame, column: str) -> DataFrame:
    c = col(column)
    long = ~X.is_nullish(c) & (F.length(C.number_text(c)) == 15)
    ok = long & C.imei(c)["valid"]
    return df.agg(count_if(long).alias("imei_checked"), count_if(ok).alias("imei_valid"),
                  ratio(count_if(ok), count_if(long)).alias("imei_valid_rate"))


def imsi_rates(df: DataFrame, column: str, home_mcc: str = "602", known_mccs: Sequence[str] | None = None) -> DataFrame:
    c = col(column)
    long = ~X.is_nullish(c) & F.length(C.number_text(c)).isin(14, 15)
    r = C.imsi(c, home_mcc, known_mccs)
    ok = long & r["valid"]
    return df.agg(count_if(long).alias("imsi_checked"), count_if(ok).alias("imsi_valid"),
                  ratio(count_if(ok), count_if(long)).alias("imsi_valid_rate"),
                  ratio(count_if(ok & r["is_home"]), count_if(ok)).alias("imsi_home_rate"))


def msisdn_stats(df: DataFrame, column: str) -> DataFrame:
    """Valid rate and surface forms of typed mobile numbers."""
    s, usable = F.trim(col(column)), ~X.is_nullish(col(column))
    d = C.digits_of(s)
    valid = C.msisdn_egypt(col(column)).isNotNull()
    form = (F.when(s.startswith("+20"), "plus_20").when(d.startswith("0020"), "double_zero")
            .when(d.startswith("20") & (F.length(d) == 12), "bare_20_12").when(d.startswith("0") & (F.length(d) == 11), "leading_zero_11")
            .when(d.rlike("^1[0125][0-9]{8}$"), "bare_10"))
    forms = ["bare_10", "leading_zero_11", "bare_20_12", "plus_20", "double_zero"]
    return df.where(usable).agg(
        F.count(F.lit(1)).alias("checked"), count_if(valid).alias("normalized_valid"),
        ratio(count_if(valid), F.count(F.lit(1))).alias("msisdn_valid_rate"),
        *[count_if(form == f).alias(f) for f in forms],
        count_if(s.rlike(r"[\s\-]") & (d != "")).alias("spaced_or_dashed"), count_if(s.endswith(".0")).alias("excel_float"))


def msisdn_prefixes(df: DataFrame, column: str) -> DataFrame:
    """Share of each national prefix among valid numbers, with the first operator of the prefix."""
    canon = C.msisdn_egypt(col(column))
    groups = df.where(canon.isNotNull()).groupBy(F.concat(F.lit("0"), F.substring(canon, 4, 2)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    total = groups.agg(F.sum("n").alias("total"))          # at most four prefixes
    return groups.crossJoin(total).select("prefix", "n", (F.col("n") / F.col("total")).alias("share"),
                                          C.operator(F.concat(F.col("prefix"), F.lit("00000000"))).alias("operator"))


def digit_lengths(df: DataFrame, column: str) -> DataFrame:
    d = C.digits_of(col(column))
    return df.where(~X.is_nullish(col(column)) & (d != "")).groupBy(F.length(d).alias("digits")).agg(F.count(F.lit(1)).alias("n"))


def checksum_rates(df: DataFrame, column: str, as_of: str | None = None) -> DataFrame:
    """Pass rates of the checksum families among values of their length."""
    d, usable = C.digits_of(col(column)), ~X.is_nullish(col(column))
    long15, card, long14 = usable & (F.length(d) == 15), usable & d.rlike("^89[0-9]{15,18}$"), usable & (F.length(d) == 14)
    return df.agg(
        ratio(count_if(long15 & C.luhn(d)), count_if(long15)).alias("luhn_pass_rate"),
        ratio(count_if(card & C.iccid(d)), count_if(card)).alias("iccid_pass_rate"),
        ratio(count_if(long14 & C.egypt_nid(d, as_of)["valid"]), count_if(long14)).alias("egypt_nid_pass_rate"))


# --- phone -----------------------------------------------------------------------------------------------

def name_tokens(name: Column) -> Column:
    return F.split(F.lower(name), r"[^a-z0-9؀-ۿ]+")


def name_is_network(name: Column) -> Column:
    return name.rlike(V.NETWORK_NAME)


def name_has_phone(name: Column) -> Column:
    low = F.lower(name)
    hit = F.lit(False)
    for t in V.PHONE_NAME_TOKENS:
        hit = hit | low.contains(t)
    return hit & ~name_is_network(name)


def name_is_identifier(name: Column) -> Column:
    return F.lower(name).endswith("_id") | F.arrays_overlap(F.split(F.lower(name), "[^a-z0-9]+"), lit_list(V.ID_NAME_TOKENS))


def phone_gate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whether the phone engine should look at a column: name, majority phone-shaped, or any leading +."""
    s = F.trim(F.col("value"))
    d = C.digits_of(s)
    compact = F.regexp_replace(s, r"\s", "")
    shaped = s.rlike(r"^[\d+\-\s().]+$") & F.length(d).between(7, 15) & (F.length(d) / F.greatest(F.length(compact), F.lit(1)) >= 0.70)
    usable = ~X.is_nullish(F.col("value"))
    agg = unpivot(df, columns).groupBy("column").agg(
        count_if(usable).alias("n"), count_if(usable & shaped).alias("shaped"), count_if(usable & s.startswith("+")).alias("plus"))
    return agg.select("column", ratio(F.col("shaped"), F.col("n")).alias("phone_shaped_rate"), (F.col("plus") > 0).alias("any_plus"),
                      (name_has_phone(F.col("column")) | ((F.col("n") > 0) & (F.col("shaped") / F.greatest("n", F.lit(1)) >= 0.5))
                       | (F.col("plus") > 0)).alias("run_phone"))


def phone_rates(df: DataFrame, column: str, region: str = "EG") -> DataFrame:
    """Valid and mobile rate over all values of the column; ``unknown_plan`` counts numbers whose country code has no plan here (they are not valid, nor known to be wrong)."""
    return df.select(C.phone(col(column), region).alias("p")).agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col("p.valid")).alias("valid"), count_if(F.col("p.mobile")).alias("mobile"),
        count_if(F.col("p.unknown")).alias("unknown_plan"), ratio(count_if(F.col("p.valid")), F.count(F.lit(1))).alias("valid_rate"),
        ratio(count_if(F.col("p.mobile")), F.count(F.lit(1))).alias("mobile_rate"),
        F.array_sort(F.collect_set("p.region")).alias("regions"))          # one entry per plan region


# --- geography -------------------------------------------------------------------------------------------

# fixed values: named fences as (lat min, lat max, lon min, lon max)
FENCES = {"egypt": (22.0, 32.0, 24.0, 37.0)}


def in_fence(lat: Column, lon: Column, fence: str = "egypt") -> Column:
    a, b, c, d = FENCES[fence]
    return lat.between(a, b) & lon.between(c, d)


def geo_partners(columns: DataFrame) -> DataFrame:
    """Latitude / longitude partner of every column of a column catalogue (table_name, column)."""
    toks = F.filter(name_tokens(F.col("column")), lambda t: t != "")
    lat = F.arrays_overlap(toks, lit_list(V.LAT_TOKENS))
    lon = F.arrays_overlap(toks, lit_list(V.LON_TOKENS)) | (
        F.array_contains(toks, "long") & F.arrays_overlap(toks, lit_list(["coord", "gps", "geo", "position"])))
    stem = F.array_join(F.filter(toks, lambda t: ~t.isin([*V.LAT_TOKENS, *V.LON_TOKENS, "long"])), "_")
    c = columns.select("table_name", "column", lat.alias("lat"), lon.alias("lon"), stem.alias("stem"))
    la = c.where("lat").select("table_name", "stem", F.col("column").alias("lat_column"))
    lo = c.where("lon").select("table_name", "stem", F.col("column").alias("lon_column"))
    by_stem = la.join(lo, ["table_name", "stem"]).where("lat_column <> lon_column").select("table_name", "lat_column", "lon_column")
    rest_la = la.join(by_stem, ["table_name", "lat_column"], "left_anti").groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("lat_column").alias("lat_column")).where("n = 1").drop("n")
    rest_lo = lo.join(by_stem, ["table_name", "lon_column"], "left_anti").groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("lon_column").alias("lon_column")).where("n = 1").drop("n")
    return by_stem.unionByName(rest_la.join(rest_lo, "table_name"))


def geo_signals(df: DataFrame, column: str, partner: str | None = None, fence: str = "egypt", min_decimals: int = 4) -> DataFrame:
    """Range class, precision, null island, fence and distinct rates of a coordinate column (same-row pairs)."""
    t = F.trim(col(column).cast("string"))
    usable = ~X.is_nullish(t)
    v = F.when(usable, F.regexp_replace(t, ",", "").try_cast("double"))
    places = F.when(usable, F.length(F.regexp_extract(t, r"\.([0-9]*)", 1)))
    aggs = [count_if(usable).alias("checked"), count_if(F.abs(v) > 180).alias("far"), count_if(v.between(-90, 90)).alias("lat_ok"),
            count_if(v.between(-180, 180)).alias("lon_ok"), count_if(v == 0).alias("zero"), F.coalesce(F.max(F.abs(v)), F.lit(0.0)).alias("abs_max"),
            F.coalesce(F.percentile(places, 0.5), F.lit(0.0)).alias("decimal_places_median")]    # a value has few decimals
    if partner:
        w = F.when(~X.is_nullish(col(partner).cast("string")), col(partner).cast("string").try_cast("double"))
        direct = (F.abs(v) <= 90) & (F.abs(w) <= 180)
        swapped = ~direct & (F.abs(w) <= 90) & (F.abs(v) <= 180)
        lat, lon = F.when(direct, v).when(swapped, w), F.when(direct, w).when(swapped, v)
        aggs += [count_if(lat.isNotNull() & lon.isNotNull()).alias("pairs"), count_if(in_fence(lat, lon, fence)).alias("inside")]
    row = df.agg(*aggs)
    if not partner:
        row = row.withColumn("pairs", F.lit(0)).withColumn("inside", F.lit(0))
    distinct = df.where(usable).groupBy(t.alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(
        ratio(F.count(F.lit(1)), F.sum("n")).alias("distinct_rate"))
    n = F.col("checked")
    rng = (F.when((n == 0) | (F.col("far") > 0), "none").when(F.col("abs_max") > 90, "longitude")
           .when((F.col("lat_ok") == n) & (F.col("lon_ok") == n), "both").when(F.col("lat_ok") == n, "latitude")
           .when(F.col("lon_ok") == n, "longitude").otherwise("none"))
    return row.crossJoin(distinct).select(
        "checked", rng.alias("range_signal"), (F.col("decimal_places_median") >= min_decimals).alias("precision_signal"),
        ratio(F.col("zero"), n).alias("null_island_rate"), ratio(F.col("inside"), F.col("pairs")).alias("geofence_rate"),
        F.coalesce("distinct_rate", F.lit(0.0)).alias("distinct_rate"), "abs_max", "decimal_places_median",
        F.lit(partner is not None).alias("partner_signal"))


def geo_scale(df: DataFrame, a: str, b: str, fence: str = "egypt", min_fence_rate: float = 0.80) -> DataFrame:
    """1e6 or 1e7 when both columns look like scaled coordinates, else null."""
    ia, ib = (F.abs(F.trim(col(c).cast("string")).try_cast("bigint")) for c in (a, b))
    sized = (F.length(ia.cast("string")).between(7, 9)) & (F.length(ib.cast("string")).between(7, 9))
    aggs = [count_if(sized).alias("n")]
    for p in (6, 7):
        x, y = ia / F.lit(10.0 ** p), ib / F.lit(10.0 ** p)
        direct = sized & (x <= 90) & (y <= 180)
        swapped = sized & ~direct & (y <= 90) & (x <= 180)
        aggs += [count_if(direct | swapped).alias(f"ok{p}"),
                 count_if((direct & in_fence(x, y, fence)) | (swapped & in_fence(y, x, fence))).alias(f"in{p}")]
    row = df.agg(*aggs)
    good = {p: (F.col("n") > 0) & (F.col(f"ok{p}") / F.col("n") >= 0.95) & (F.col(f"in{p}") / F.col(f"ok{p}") >= min_fence_rate) for p in (6, 7)}
    return row.select(F.when(good[6], 1000000).when(good[7], 10000000).alias("scale"))


def geo_verdict(name_signal: Column, partner: Column, rng: Column, precision: Column, fence_rate: Column, scale: Column,
                require_pair: bool = True) -> Column:
    strong = name_signal | precision | (fence_rate >= 0.80) | scale.isNotNull()
    blocked = (rng == "none") | (~partner if require_pair else F.lit(False))
    return F.when(~blocked & strong, rng).otherwise("none")


def geo_confidence(name_signal: Column, partner: Column, rng: Column, precision: Column, fence_rate: Column, scale: Column,
                   require_pair: bool = True) -> Column:
    """Weights .30 name, .30 partner, .25 precision, .15 fence, .10 scaled integers."""
    total = (F.when(name_signal, 0.30).otherwise(0.0) + F.when(partner, 0.30).otherwise(0.0) + F.when(precision, 0.25).otherwise(0.0)
             + 0.15 * F.least(F.lit(1.0), fence_rate) + F.when(scale.isNotNull(), 0.10).otherwise(0.0))
    none = geo_verdict(name_signal, partner, rng, precision, fence_rate, scale, require_pair) == "none"
    return F.when(none, 0.0).otherwise(F.round(F.least(F.lit(1.0), total), 4))


# --- names and hits --------------------------------------------------------------------------------------

def name_signals(hits: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Hits (table_name, column, pattern_name, entity_type, score, match_rate) after the column name has spoken.

    Negative tokens drop an entity, look-alike groups keep the pattern the name picks, and the best remaining hit
    of each column is boosted when the name carries one of its hints.
    """
    spark = hits.sparkSession
    keys = ["table_name", "column"]
    named = hits.withColumn("_name", X.fold_name(F.col("column"))) \
        .withColumn("_tokens", F.split("_name", r"[^a-z0-9؀-ۿ]+"))
    negative = F.lit(False)
    for entity, tokens in V.NEGATIVE_TOKENS.items():
        negative = negative | ((F.col("entity_type") == entity) & F.arrays_overlap("_tokens", lit_list(tokens.split())))
    named = named.where(~negative)
    # look-alikes: score of each pattern of a group by how many of its tokens the name holds
    groups: dict[str, list[tuple[str, list[str]]]] = {}
    for g, p, toks in V.COLLISIONS:
        groups.setdefault(g, []).append((p, toks.split()))
    picks = []
    for g, entries in groups.items():
        score = [F.size(F.filter(lit_list(toks), lambda t: F.contains(F.lower(F.col("column")), t))) for _, toks in entries]
        best = F.greatest(*score) if len(score) > 1 else score[0]
        pick = F.lit(None).cast("string")
        for (p, _), s in reversed(list(zip(entries, score))):
            pick = F.when(s == best, p).otherwise(pick)
        picks.append(F.struct(F.lit(g).alias("g"), F.when(best > 0, pick).alias("p")))
    winner = F.map_from_entries(F.array(*picks))
    picked = named.withColumn("_pick", F.try_element_at(winner, F.col("collision_group")))
    members = lit_list([p for _, p, _ in V.COLLISIONS])
    kept = picked.where(F.col("_pick").isNull() | (F.col("_pick") == F.col("pattern_name")) | ~F.array_contains(members, F.col("pattern_name")))
    cat = patterns if patterns is not None else catalog_rows(spark)
    hints = cat.groupBy("entity_type").agg(F.flatten(F.collect_list(F.split("hints", " "))).alias("_hints"))
    hinted = kept.join(F.broadcast(hints), "entity_type", "left") \
        .withColumn("context_hit", F.coalesce(F.exists("_hints", lambda h: F.contains(F.col("_name"), X.fold_name(h))), F.lit(False)))
    # a column has at most one hit per catalogue pattern
    w = W.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("match_rate").desc(), "pattern_name")
    top = F.row_number().over(w) == 1
    return hinted.withColumn("_top", top).withColumn(
        "score", F.when(F.col("_top") & F.col("context_hit"), F.least(F.lit(1.0), F.col("score") + CONTEXT_BOOST)).otherwise(F.col("score"))) \
        .drop("_name", "_tokens", "_pick", "_hints", "_top")


def sim_class_rates(df: DataFrame, columns: Sequence[str], as_of: str | None = None) -> DataFrame:
    """Dominant class of 14/15-digit values per column, and whether any value starts with 602 or has a known code."""
    d = C.digits_of(F.col("value"))
    long = F.length(d).isin(14, 15)
    known = C.imsi(d)["valid"]
    kind = (F.when(~long | ((F.length(d) == 14) & C.egypt_nid(d, as_of)["valid"]), None).when(known, "IMSI")
            .when((F.length(d) == 15) & C.iccid(d), "ICCID").when((F.length(d) == 15) & C.luhn(d), "IMEI"))
    rows = unpivot(df, columns).where(~X.is_nullish(F.col("value"))).groupBy("column").agg(
        *[count_if(kind == k).alias(k) for k in ("IMSI", "ICCID", "IMEI")],
        (count_if(d.startswith("602")) > 0).alias("has_602"), (count_if(known) > 0).alias("any_imsi"))
    best = F.greatest("IMSI", "ICCID", "IMEI")
    dominant = F.when(best == 0, None).when(F.col("IMSI") == best, "IMSI").when(F.col("ICCID") == best, "ICCID").otherwise("IMEI")
    return rows.select("column", dominant.alias("dominant"), "has_602", "any_imsi")


def postprocess(hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """Phone injection, SIM gates, geography gates and the national-id preference over hit rows.

    ``evidence`` has one row per (table_name, column): msisdn_valid_rate, dominant, has_602, any_imsi,
    geo_verdict, geo_confidence, geofence_rate, has_partner, fence_option.
    """
    keys = ["table_name", "column"]
    sure = ["gps_pair", "wkt_point", "gps_dms"]
    lone = ["gps_latitude", "gps_longitude", "gps_scaled_int"]
    fifteen = ["imei", "imsi_strict", "imsi_egypt", "imsi_generic", "iccid", "iccid_egypt"]
    injected = evidence.where("msisdn_valid_rate > 0").select(
        *keys, F.lit("msisdn_egypt_normalized").alias("pattern_name"), F.lit("PHONE_NUMBER").alias("entity_type"),
        F.lit(0.92).alias("score"), F.round("msisdn_valid_rate", 4).alias("match_rate"), F.lit(1.0).alias("valid_rate"),
        F.lit(False).alias("context_hit"), F.lit(None).cast("string").alias("validator"))
    cols = [*keys, "pattern_name", "entity_type", "score", "match_rate", "valid_rate", "context_hit", "validator"]
    h = hits.select(*cols).unionByName(injected).join(evidence, keys, "left")
    p, e, hint = F.col("pattern_name"), F.col("entity_type"), F.coalesce("context_hit", F.lit(False))
    drop = (p == "imsi_strict") & ~F.coalesce("has_602", F.lit(False)) & ~hint
    drop = drop | (p.isin(fifteen) & F.col("dominant").isNotNull() & (e != F.col("dominant")) & ~hint)
    drop = drop | ((e == "IMEI") & (F.col("dominant") == "IMSI") & ~hint)
    drop = drop | ((e == "IMSI") & (F.col("dominant") == "IMEI") & ~hint & ~F.coalesce("any_imsi", F.lit(False)))
    drop = drop | (F.col("validator").isNotNull() & (F.col("valid_rate") < 0.5) & ~(p.isin("imei", "imei_with_dashes") & hint))
    drop = drop | (p.isin(lone) & (F.coalesce("geo_verdict", F.lit("none")) == "none"))
    boost = F.coalesce(F.col("fence_option") & (F.col("geofence_rate") >= 0.80) & (F.col("has_partner") | (p == "gps_pair")), F.lit(False))
    score = F.when(p.isin(sure + lone) & boost, F.least(F.lit(1.0), F.col("score") + 0.10)).otherwise(F.col("score"))
    score = F.when((p == "gps_scaled_int") & F.col("geo_scale").isNotNull(), F.greatest(score, F.lit(0.70))).otherwise(score)
    kept = h.where(~F.coalesce(drop, F.lit(False))).withColumn("score", F.round(score, 4))
    w = W.partitionBy(*keys)
    nid = F.max(F.when(e == "EG_NATIONAL_ID", F.col("match_rate"))).over(w)
    sim = F.max(F.when(e == "IMSI", F.col("match_rate"))).over(w)
    out = kept.withColumn("_nid", nid).withColumn("_sim", sim) \
        .where(~((e == "IMSI") & F.coalesce(F.col("_nid") >= F.col("_sim"), F.lit(False))))
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("match_rate").desc(), "pattern_name")
    return out.withColumn("rank", F.row_number().over(order)).select(*keys, "rank", "pattern_name", "entity_type", "score", "match_rate")


def resolve_entity(evidence: DataFrame, phone_min: float = 0.80, regex_min: float = 0.80, ner_min: float = 0.70) -> DataFrame:
    """Phone plan score, phone eligibility and the entity of the column from its scores."""
    rates = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.col(c)) for c in ("msisdn_valid_rate", "mobile_rate", "phone_valid_rate")]))
    score = F.array_max(rates)
    e = evidence.withColumn("phone_score", score)
    eligible = phone_vote(e, {"phone": F.lit(phone_min), "regex": F.lit(regex_min), "ner": F.lit(ner_min)})
    e = e.withColumn("phone_eligible", eligible)
    best_other = F.when(F.coalesce(F.col("regex_score"), F.lit(0.0)) >= F.coalesce(F.col("ner_score"), F.lit(0.0)), F.col("entity_type")) \
        .otherwise(F.col("ner_label"))
    blocked = ~F.col("phone_eligible") | name_is_network(F.col("column"))
    entity = F.when(F.col("phone_eligible") & (F.col("phone_score") >= phone_min), "PHONE_NUMBER") \
        .when((best_other == "PHONE_NUMBER") & blocked, F.when(F.col("ner_label") != "PHONE_NUMBER", F.col("ner_label"))).otherwise(best_other)
    return e.withColumn("resolved_entity", entity)


# --- verdicts --------------------------------------------------------------------------------------------

# fixed values
THRESHOLDS = {"regex": 0.80, "ner": 0.70, "review": 0.82, "phone": 0.80, "nid": 0.85, "imei": 0.85, "imsi": 0.90,
              "geo": 0.75, "learned": 0.90, "very_high": 0.90}
MODES = ["lenient", "independent", "strict", "balanced"]


def _col_or_null(df: DataFrame, name: str, type_: str = "double") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(type_)


def is_phone_label(label: Column) -> Column:
    up, low = F.upper(F.regexp_replace(label, " ", "_")), F.lower(label)
    return F.coalesce(up.isin("PHONE_NUMBER", "PHONE", "MSISDN") | low.rlike("phone|mobile|msisdn|tel"), F.lit(False))


def phone_vote(e: DataFrame, t: dict[str, Column]) -> Column:
    """Shape alone never decides: the name must speak of phones, or two engines agree."""
    name = F.col("column")
    phone, regex, ner = F.col("phone_score"), F.coalesce(_col_or_null(e, "regex_phone_score"), F.col("regex_score")), F.col("ner_score")
    rx_phone = _col_or_null(e, "regex_phone_score").isNotNull() | is_phone_label(F.col("entity_type"))
    ner_phone = is_phone_label(F.col("ner_label"))
    by_phone = F.coalesce(phone >= t["phone"], F.lit(False))
    by_regex = F.coalesce((regex >= t["regex"]) & rx_phone, F.lit(False))
    by_ner = F.coalesce((ner >= t["ner"]) & ner_phone, F.lit(False))
    votes = by_phone.cast("int") + by_regex.cast("int") + by_ner.cast("int")
    named = name_has_phone(name)
    blocked = name_is_network(name) | (name_is_identifier(name) & ~named) | \
        F.coalesce(_col_or_null(e, "phone_valid_rate") < t["phone"], F.lit(False))
    return ~blocked & ((named & (votes >= 1)) | (~named & by_phone & (votes >= 2)))


def _structural(e: DataFrame, t: dict[str, Column]) -> Column:
    entity = F.upper(F.regexp_replace(F.coalesce("entity_type", F.lit("")), " ", "_"))
    ok = F.lit(True)
    for name, rate, key in (("EG_NATIONAL_ID", "nid_valid_rate", "nid"), ("IMEI", "imei_valid_rate", "imei"),
                            ("IMSI", "imsi_valid_rate", "imsi"), ("LOCATION", "geo_confidence", "geo")):
        value, ran = _col_or_null(e, rate), F.coalesce(_col_or_null(e, f"{key}_ran", "boolean"), F.lit(False))
        ok = ok & ((entity != name) | F.coalesce(value >= t[key], ~ran))
    return ok


def decide(evidence: DataFrame, mode: str | Column = "balanced", thresholds: dict[str, Any] | None = None,
           learned_enabled: bool = False, learned_promoted: bool = False) -> DataFrame:
    """Evidence rows + detected, confidence, equation; the evidence itself is never changed."""
    t = {k: (v if isinstance(v, Column) else F.lit(float(v))) for k, v in {**THRESHOLDS, **(thresholds or {})}.items()}
    mode = mode if isinstance(mode, Column) else F.lit(mode)
    e = evidence
    gate = _structural(e, t)
    pv = phone_vote(e, t)
    regex, ner, review, phone = F.col("regex_score"), F.col("ner_score"), F.col("review_score"), F.col("phone_score")
    learned = _col_or_null(e, "learned_score")
    rx_phone = _col_or_null(e, "regex_phone_score").isNotNull() | is_phone_label(F.col("entity_type"))
    v_regex = F.coalesce(regex >= t["regex"], F.lit(False)) & gate & F.when(rx_phone, pv).otherwise(True)
    v_ner = F.coalesce(ner >= t["ner"], F.lit(False)) & gate & F.when(is_phone_label(F.col("ner_label")), pv).otherwise(True)
    v_review = F.coalesce(review >= t["review"], F.lit(False))
    counted = F.lit(learned_enabled) & F.coalesce(learned >= t["learned"], F.lit(False))
    v_learned = counted & (F.lit(learned_promoted) | (mode == "balanced"))
    any_vote = v_regex | v_ner | v_review | pv | v_learned
    pairs = [(regex, v_regex), (ner, v_ner), (review, v_review), (phone, pv)]
    voted = F.lit(False)
    all_yes = F.lit(True)
    yes = v_learned.cast("int")
    for s, v in pairs:
        voted, all_yes, yes = voted | s.isNotNull(), all_yes & (s.isNull() | v), yes + (s.isNotNull() & v).cast("int")
    strict_learned = learned.isNotNull() & F.lit(learned_enabled and learned_promoted)
    strict = (voted | strict_learned) & all_yes & (~strict_learned | (learned >= t["learned"]))
    top = F.greatest(regex, ner, review, phone, *([learned] if learned_promoted else [learned * 0]))
    balanced = (yes >= 2) | ((yes >= 1) & F.coalesce(top >= t["very_high"], F.lit(False)))
    verdict = F.when(mode.isin("lenient", "independent"), any_vote).when(mode == "strict", strict).otherwise(balanced) & gate
    confidence = F.when(verdict, F.coalesce(F.greatest(regex, ner, review, phone, learned), F.lit(0.0))).otherwise(0.0)
    return e.withColumns({"detected": verdict, "confidence": confidence, "equation": mode, "vote_regex": v_regex, "vote_ner": v_ner,
                          "vote_review": v_review, "vote_phone": pv})


def report(decided: DataFrame) -> DataFrame:
    """Decision text, the engine it rests on and the state of every engine."""
    engines = [("regex", "regex_score", "vote_regex"), ("ner", "ner_score", "vote_ner"), ("review", "review_score", "vote_review"),
               ("phone", "phone_score", "vote_phone")]
    voted = F.array_compact(F.array(*[F.when(F.col(v), F.struct(F.col(s).alias("s"), F.lit(n).alias("n"))) for n, s, v in engines]))
    basis = F.array_max(voted)["n"]
    states = F.array(*[F.struct(F.lit(n).alias("engine"), F.col(s).alias("score"),
                                F.when(F.col(s).isNull(), "not run").when(F.col(v), "yes").otherwise("no").alias("state")) for n, s, v in engines])
    text = F.when(F.col("detected"), F.concat(F.col("entity_type"), F.lit(" by "), F.coalesce(basis, F.lit("gate")), F.lit(" ("), F.col("equation"), F.lit(")"))) \
        .otherwise(F.concat(F.lit("not personal data ("), F.col("equation"), F.lit(")")))
    return decided.select(*[c for c in ("table_name", "column") if c in decided.columns], "detected", "confidence",
                          basis.alias("basis"), text.alias("decision"), states.alias("engines"))


def canonical_entity(c: Column) -> Column:
    out = c
    for alias, name in V.ALIASES.items():
        out = F.when(c == alias, name).otherwise(out)
    return out


def sensitivity(entity: Column) -> Column:
    e = canonical_entity(entity)
    return (F.when(e.isNull() | e.isin(V.NON_PII), "internal").when(e.isin(V.SENSITIVE), "pii_sensitive")
            .when(e.isin(V.SECURITY), "security_sensitive").when(e.isin(V.INDIRECT), "pii_indirect")
            .when(e.isin(V.PERSONAL), "pii_personal").otherwise("internal"))


LEVELS = ["internal", "pii_indirect", "pii_personal", "security_sensitive", "pii_sensitive"]


def strictest(evidence: DataFrame) -> DataFrame:
    """The strictest level of each table."""
    level = sensitivity(F.col("entity_type"))
    rank = F.array_position(lit_list(LEVELS), level)
    return evidence.groupBy("table_name").agg(F.max_by(level, rank).alias("classification"))


def edge_rules(evidence: DataFrame, rules: Sequence[dict[str, Any]]) -> DataFrame:
    """Ordered when/then rules, first match wins; a passed checksum blocks re-labelling.

    Evidence columns used: column, entity_type, detected, logical_type, min_value, max_value, cardinality_ratio,
    null_rate, valid_rate, luhn_checksum / iccid_checksum / nid_checksum ("pass" / "fail"), context_hit, regions.
    """
    def test(key: str, want: Any) -> Column:
        if key == "name_matches":
            return F.col("column").rlike(str(want))
        if key == "entity":
            return canonical_entity(F.col("entity_type")) == V.ALIASES.get(want, want)
        if key == "logical_type":
            return F.lower("logical_type") == str(want).lower()
        if key == "is_numeric":
            return F.col("logical_type").isin("integer", "float", "number", "double", "decimal") == bool(want)
        if key == "is_integer":
            return (F.col("logical_type") == "integer") == bool(want)
        if key == "in_range":
            return (F.col("min_value") >= want[0]) & (F.col("max_value") <= want[1])
        if key == "cardinality_ratio_gte":
            return F.col("cardinality_ratio") >= want
        if key == "cardinality_ratio_lte":
            return F.col("cardinality_ratio") <= want
        if key == "null_rate_lte":
            return F.col("null_rate") <= want
        if key == "valid_rate_gte":
            return F.col("valid_rate") >= want
        if key in ("luhn_checksum", "iccid_checksum", "nid_checksum"):
            return F.col(key) == str(want)
        if key == "context_hit":
            return F.col("context_hit") == bool(want)
        if key == "region_in":
            return F.arrays_overlap("regions", lit_list(want if isinstance(want, list) else [want]))
        raise ValueError(f"unknown condition {key}")
    backed = F.lit(False)
    for k in ("luhn_checksum", "iccid_checksum", "nid_checksum"):
        if k in evidence.columns:
            backed = backed | F.coalesce(F.col(k) == "pass", F.lit(False))
    keys = ["set_entity", "forbid_entity", "set_classification", "set_masking_policy", "note"]
    pick = F.lit(None).cast("struct<id:string,set_entity:string,forbid_entity:string,set_classification:string,"
                            "set_masking_policy:string,note:string,require_review:boolean,add_tags:array<string>>")
    for r in reversed(list(rules)):
        then = r.get("then") or {}
        cond = F.lit(True)
        for k, w in (r.get("when") or {}).items():
            cond = cond & F.coalesce(test(k, w), F.lit(False))
        new = then.get("set_entity")
        if new:
            same = canonical_entity(F.col("entity_type")) == V.ALIASES.get(new, new)
            cond = cond & ~(backed & ~F.coalesce(same, F.lit(False)))
        body = F.struct(F.lit(str(r.get("id") or "")).alias("id"), *[F.lit(then.get(k)).cast("string").alias(k) for k in keys],
                        F.lit(bool(then.get("require_review"))).alias("require_review"),
                        lit_list(list(then.get("add_tags") or [])).cast("array<string>").alias("add_tags"))
        pick = F.when(cond, body).otherwise(pick)
    out = evidence.withColumn("edge", pick)
    now = canonical_entity(F.col("entity_type"))
    demote = F.coalesce((F.col("edge.set_entity") == "NOT_PII") | (F.col("edge.forbid_entity") == now), F.lit(False))
    raised = F.col("edge.set_entity").isNotNull() & ~demote
    return out.select(
        *[c for c in evidence.columns if c not in ("entity_type", "detected")],
        F.when(demote, None).when(raised, canonical_entity(F.col("edge.set_entity"))).otherwise(F.col("entity_type")).alias("entity_type"),
        F.when(demote, False).when(raised, True).otherwise(F.col("detected")).alias("detected"),
        F.col("edge.id").alias("edge_rule_id"), F.coalesce("edge.require_review", F.lit(False)).alias("require_review"),
        F.coalesce("edge.add_tags", F.array().cast("array<string>")).alias("edge_tags"),
        F.col("edge.set_classification").alias("edge_classification"), F.col("edge.set_masking_policy").alias("edge_masking_policy"))


def replay(evidence: DataFrame, settings: DataFrame) -> DataFrame:
    """The same evidence under every (setting, mode, threshold…) row.

    Settings are control data, a handful of rows: they become literals that every evidence row is unfolded with.
    """
    t = {k: F.col(f"t_{k}") for k in THRESHOLDS if f"t_{k}" in settings.columns}
    options = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(settings.schema.fields, row)]) for row in settings.collect()])
    return decide(evidence.select("*", F.inline(options)), F.col("mode"), t)


def verdict_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns whose verdict differs between two decisions."""
    keys = ["table_name", "column"]
    x = a.select(*keys, F.col("detected").alias("before"), F.col("confidence").alias("confidence_before"))
    y = b.select(*keys, F.col("detected").alias("after"), F.col("confidence").alias("confidence_after"))
    kind = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(F.col("before") == F.col("after"), "same") \
        .when(F.col("after"), "now_detected").otherwise("no_longer_detected")
    return x.join(y, keys, "full").select(*keys, "before", "after", kind.alias("change"))


def tuning_report(hits: DataFrame, min_columns: int = 2) -> DataFrame:
    """Patterns that fire on many columns."""
    return hits.groupBy("pattern_name", "entity_type").agg(
        F.count_distinct("table_name", "column").alias("columns"), F.max("score").alias("max_score"),
        F.avg("match_rate").alias("mean_match_rate")).where(F.col("columns") >= min_columns)


# --- tags ------------------------------------------------------------------------------------------------

def tags(candidates: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """Resolved tags of every column from candidate tags and a policy.

    Candidates: table_name, column, domain, tag, confidence, suggest_only, attributes (array of names), jurisdiction.
    A column has at most as many tags as the policy names, so one row per column holds them all.
    """
    def tag_map(d: dict[str, list[str]]) -> Column:
        return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), lit_list(v).cast("array<string>"))]) if d else \
            F.create_map().cast("map<string,array<string>>")
    forbidden = [f"{d}:{t}" for d, t in policy.get("forbidden", [])]
    key = F.concat_ws(":", "domain", "tag")
    kept = ~F.col("suggest_only") & ~key.isin(forbidden)
    base = candidates.groupBy("table_name", "column").agg(
        F.array_sort(F.collect_set(F.when(kept, key))).alias("own"),
        F.array_sort(F.collect_set(F.when(F.col("suggest_only"), key))).alias("suggestions"),
        F.array_sort(F.collect_set(F.when(~F.col("suggest_only") & key.isin(forbidden), key))).alias("escalations"),
        F.max("jurisdiction").alias("jurisdiction"),
        F.flatten(F.collect_set(F.when(kept, F.transform("attributes", lambda a: F.concat(key, F.lit("."), a))))).alias("given"))
    name = lambda k: F.split_part(k, F.lit(":"), F.lit(2))
    domain = lambda k: F.split_part(k, F.lit(":"), F.lit(1))
    empty = F.array().cast("array<string>")
    cotags = F.flatten(F.transform("own", lambda k: F.coalesce(F.try_element_at(tag_map(policy.get("cotags", {})), name(k)), empty)))
    step = base.withColumn("t", F.array_union("own", cotags))
    local = F.coalesce(F.try_element_at(tag_map(policy.get("jurisdiction", {})), F.upper("jurisdiction")), empty)
    step = step.withColumn("t", F.array_union("t", local))
    order = policy["security_levels"]
    derive = policy.get("security_derivation", {})
    level_of = F.create_map(*[x for k, v in derive.items() for x in (F.lit(k), F.lit(order.index(v)))])
    best = F.array_max(F.transform(F.filter("t", lambda k: domain(k) == "DataSensitivity"), lambda k: F.try_element_at(level_of, name(k))))
    has_security = F.exists("t", lambda k: domain(k) == "DataSecurity")
    step = step.withColumn("t", F.when(~has_security & best.isNotNull(), F.array_union(
        "t", F.array(F.concat(F.lit("DataSecurity:"), F.get(lit_list(order), best))))).otherwise(F.col("t")))
    keep = policy.get("retention", {})
    days_of = F.create_map(*[x for k, (d, tg) in keep.items() for x in (F.lit(k), F.struct(F.lit(d).alias("days"), F.lit(tg).alias("tag")))])
    longest = F.array_max(F.array_compact(F.transform("t", lambda k: F.try_element_at(days_of, name(k)))))
    step = step.withColumn("_r", longest).withColumn("t", F.when(F.col("_r").isNotNull(), F.array_union(
        "t", F.array(F.concat(F.lit("RetentionPolicy:"), F.col("_r.tag"))))).otherwise(F.col("t")))
    def has_domain(d: str) -> Column:
        return F.exists("t", lambda k: domain(k) == d)

    def count_domain(d: str) -> Column:
        return F.size(F.filter("t", lambda k: domain(k) == d))
    checks = []
    level = F.array_max(F.transform(F.filter("t", lambda k: domain(k) == "DataSecurity"),
                                    lambda k: F.array_position(lit_list(order), name(k)).cast("int")))
    for r in policy.get("golden_rules", []):
        rid = F.lit(r["id"])
        if r["rule"] == "exactly_one":
            bad = count_domain(r["domain"]) != 1
        elif r["rule"] == "min_security_for_domain":
            bad = has_domain(r["trigger_domain"]) & \
                (F.coalesce(level, F.lit(0)) < order.index(r["min_security"]) + 1)
        elif r["rule"] == "mutually_exclusive":
            bad = F.size(F.array_intersect("t", lit_list(r["tags"]))) > 1
        else:
            bad = F.array_contains("t", r["when_tag"]) & ~has_domain(r["requires_domain"])
        checks.append(F.when(bad, rid))
    needed = [(k, a) for k, attrs in policy.get("required_attributes", {}).items() for a in attrs]
    for k, a in needed:
        checks.append(F.when(F.array_contains("t", k) & ~F.array_contains("given", f"{k}.{a}"), F.lit(f"missing_attribute:{k}.{a}")))
    role = F.lit("Steward")
    for r in reversed(["SecOps", "Legal", "DPO", "Architecture", "Steward"]):
        pats = policy.get("role_routing", {}).get(r, [])
        hit = F.lit(False)
        for p in pats:
            hit = hit | (has_domain(p[:-2]) if p.endswith(".*") else F.array_contains("t", p.replace(".", ":")))
        role = F.when(hit, r).otherwise(role)
    return step.select("table_name", "column", F.array_sort("t").alias("tags"), "suggestions", "escalations",
                       F.col("_r.days").alias("retention_days"),
                       F.array_compact(F.array(*checks)).alias("violations") if checks else empty.alias("violations"),
                       F.when(F.size("escalations") > 0, "SecOps").otherwise(role).alias("approval_role"))

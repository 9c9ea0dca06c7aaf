"""What changed and who decides: drift, verdict overlays, contract and span diffs, training rows, scrubbing, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.columns import col
from tablewarden.functions.spans import overlaps

KEYS = ["table_name", "column"]
SNAPSHOT = ["name_normalized", "logical_type", "physical_type", "format_signature"]


def schema(contract_columns: DataFrame, observed: DataFrame) -> DataFrame:
    """added / dropped columns of a table against its contract (both sides one row per column)."""
    a = contract_columns.select("column").distinct().withColumn("_c", F.lit(True))
    b = observed.select("column").distinct().withColumn("_o", F.lit(True))
    change = F.when(F.col("_c").isNull(), "added").when(F.col("_o").isNull(), "dropped").otherwise("kept")
    return a.join(b, "column", "full").select("column", change.alias("change"))


def fingerprint_key(*parts: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def columns(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Drift state of every column: keys + the snapshot fields (+ lifecycle_state on the baseline)."""
    b = baseline.select(*KEYS, F.lit(True).alias("_b"), fingerprint_key(*SNAPSHOT).alias("b_key"), *[F.col(c).alias(f"b_{c}") for c in SNAPSHOT],
                        (F.col("lifecycle_state") if "lifecycle_state" in baseline.columns else F.lit(None).cast("string")).alias("lifecycle"))
    c = current.select(*KEYS, F.lit(True).alias("_c"), fingerprint_key(*SNAPSHOT).alias("c_key"), *[F.col(x).alias(f"c_{x}") for x in SNAPSHOT])
    j = b.join(c, KEYS, "full")
    same = F.col("b_key") == F.col("c_key")
    state = F.when(F.lower("lifecycle") == "superseded", "superseded").when(F.col("_b").isNull(), "legacy").when(F.col("_c").isNull(), "removed") \
        .when(same, "active").otherwise("stale")
    names = {"name_normalized": "column_rename_or_normalization_change", "logical_type": "logical_type_changed",
             "physical_type": "physical_type_changed", "format_signature": "format_signature_changed"}
    changed = F.array_compact(F.array(*[F.when(~F.col(f"b_{x}").eqNullSafe(F.col(f"c_{x}")), r) for x, r in names.items()]))
    reasons = (F.when(state == "superseded", F.array(F.lit("superseded_by_newer_decision"))).when(state == "legacy", F.array(F.lit("no_baseline_fingerprint")))
               .when(state == "removed", F.array(F.lit("column_removed_from_schema"))).when(state == "active", F.array().cast("array<string>"))
               .when(F.size(changed) > 0, changed).otherwise(F.array(F.lit("fingerprint_changed"))))
    return j.select(*KEYS, state.alias("state"), reasons.alias("reasons"), state.isin("active", "legacy").alias("authoritative"),
                    F.coalesce(same, F.col("_b").isNull()).alias("fingerprint_match"))


def effective(engine: DataFrame, steward: DataFrame, supplied: DataFrame) -> DataFrame:
    """Local steward decision while its drift state holds, else a matching supplied one, else the engine.

    engine: keys, detected, entity_type, confidence.  steward: keys, detected, entity_type, authoritative.
    supplied: keys, detected, entity_type, fingerprint_match.  Confidence always comes from the engine.
    """
    s = steward.select(*KEYS, F.col("detected").alias("s_det"), F.col("entity_type").alias("s_ent"), F.col("authoritative").alias("s_ok"))
    p = supplied.select(*KEYS, F.col("detected").alias("p_det"), F.col("entity_type").alias("p_ent"), F.col("fingerprint_match").alias("p_ok"))
    j = engine.join(s, KEYS, "left").join(p, KEYS, "left")
    by_s, by_p = F.coalesce("s_ok", F.lit(False)), F.coalesce("p_ok", F.lit(False))
    return j.select(*KEYS, F.when(by_s, F.col("s_det")).when(by_p, F.col("p_det")).otherwise(F.col("detected")).alias("detected"),
                    F.when(by_s, F.col("s_ent")).when(by_p, F.col("p_ent")).otherwise(F.col("entity_type")).alias("entity_type"), "confidence",
                    F.when(by_s, "steward").when(by_p, "supplied").otherwise("engine").alias("source"))


def attach(verdicts: DataFrame, cols: DataFrame) -> DataFrame:
    """Supplied verdicts matched to the columns of a table; locked human columns win.

    verdicts: keys, fingerprint (may be null), detected, entity_type.  cols: keys, fingerprint, locked.
    """
    c = cols.select(*KEYS, F.col("fingerprint").alias("c_fp"), "locked")
    j = verdicts.join(c, KEYS, "left")
    status = F.when(F.col("locked").isNull(), "skipped_no_column").when(F.col("locked"), "skipped_locked") \
        .when(F.col("fingerprint").isNotNull() & (F.col("fingerprint") != F.col("c_fp")), "skipped_fingerprint").otherwise("attached")
    return j.select(*KEYS, "detected", "entity_type", status.alias("status"))


DIFF_FIELDS = ["logical_type", "physical_type", "required", "unique", "classification", "description", "tags"]


def contract_diff(a: DataFrame, b: DataFrame, fields: Sequence[str] = DIFF_FIELDS, keys: Sequence[str] = ("table_name", "column_name")) -> DataFrame:
    """override / add / unchanged per column and field."""
    def long(df: DataFrame, name: str) -> DataFrame:
        text = [F.struct(F.lit(f).alias("field"), F.nullif(F.trim(F.to_json(F.struct(col(f).alias("v")))), F.lit("{}")).alias(name)) for f in fields if f in df.columns]
        return df.select(*keys, F.inline(F.array(*text)))
    j = long(a, "left_value").join(long(b, "right_value"), [*keys, "field"], "full")
    kind = F.when(F.col("left_value").eqNullSafe(F.col("right_value")), "unchanged").when(F.col("left_value").isNull(), "add").otherwise("override")
    return j.select(*keys, "field", "left_value", "right_value", kind.alias("kind"))


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def span_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """agree / type_conflict / boundary_conflict / left_only / right_only between two span sets of documents.

    Each right span takes its largest unmatched overlap on the left, in the order of the right spans.
    """
    from tablewarden.operators.text import islands
    left = a.select("doc_id", F.struct("start", "end", "entity_type").alias("l"), "start", "end", F.lit("l").alias("side"))
    right = b.select("doc_id", F.struct("start", "end", "entity_type").alias("l"), "start", "end", F.lit("r").alias("side"))
    groups = islands(left.unionByName(right), ["doc_id"]).groupBy("doc_id", "cluster").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "l", F.col("l")))).alias("ls"), F.array_sort(F.collect_list(F.when(F.col("side") == "r", F.col("l")))).alias("rs"))
    row = "array<struct<kind:string,l:struct<start:int,end:int,entity_type:string>,r:struct<start:int,end:int,entity_type:string>>>"
    span = "struct<start:int,end:int,entity_type:string>"

    def step(acc: Column, r: Column) -> Column:
        near = F.filter(acc["free"], lambda x: overlaps(x["start"], x["end"], r["start"], r["end"]))
        # the largest overlap, the earliest among equals
        best = F.array_min(F.transform(near, lambda x: F.struct((F.greatest(x["start"], r["start"]) - F.least(x["end"], r["end"])).alias("o"), x.alias("x"))))["x"]
        kind = F.when(best.isNull(), None).when((best["start"] == r["start"]) & (best["end"] == r["end"]), F.when(best["entity_type"] == r["entity_type"], "agree").otherwise("type_conflict")) \
            .when(best["entity_type"] == r["entity_type"], "boundary_conflict")
        hit = kind.isNotNull()
        done = F.struct(F.coalesce(kind, F.lit("right_only")).alias("kind"), F.when(hit, best).cast(span).alias("l"), r.cast(span).alias("r"))
        return F.struct(F.when(hit, F.array_remove(acc["free"], best)).otherwise(acc["free"]).alias("free"), F.array_append(acc["out"], done).alias("out"))
    zero = F.struct(F.col("ls").cast(f"array<{span}>").alias("free"), F.array().cast(row).alias("out"))
    done = F.aggregate("rs", zero, step, lambda acc: F.concat(acc["out"], F.transform(acc["free"], lambda x: F.struct(
        F.lit("left_only").alias("kind"), x.alias("l"), F.lit(None).cast(span).alias("r")))))
    return groups.select("doc_id", F.inline(done)).select("doc_id", "kind", "l", "r")


def variants(runs: DataFrame, modes: Sequence[str]) -> DataFrame:
    """Verdict of every column under each run variant, side by side, with how many differ."""
    wide = runs.groupBy(*KEYS).pivot("mode", list(modes)).agg(F.first("detected"))
    return wide.withColumn("distinct_verdicts", F.size(F.array_distinct(F.array_compact(F.array(*[col(m) for m in modes])))))


def training(decisions: DataFrame, reviews: DataFrame, telemetry: DataFrame, contract: DataFrame, min_confidence: float | None = None,
             disagreements_only: bool = False, sources: Sequence[str] | None = None) -> DataFrame:
    """Labelled rows: human decisions, else approved reviews, with telemetry and contract columns; one row per context.

    decisions: keys, status, entity_type, decided_by, decided_at.  reviews: keys, status, is_pii, entity_type.
    telemetry: keys, confidence, engine_detected.  contract: keys, logical_type, classification.
    """
    d = decisions.select(*KEYS, (F.col("status") == "pii").alias("is_pii"), "entity_type", "decided_by", F.lit("human_decision").alias("source"))
    r = reviews.where(F.col("status").isin("approved", "edited")).join(decisions.select(*KEYS), KEYS, "left_anti") \
        .select(*KEYS, "is_pii", "entity_type", F.lit("").alias("decided_by"), F.lit("review").alias("source"))
    rows = d.unionByName(r).join(telemetry, KEYS, "left").join(contract, KEYS, "left")
    rows = rows.withColumn("corrected_engine", F.col("engine_detected") != F.col("is_pii"))
    if sources:
        rows = rows.where(F.col("source").isin(list(sources)))
    if min_confidence is not None:
        rows = rows.where(F.col("confidence").isNull() | (F.col("confidence") >= min_confidence))
    if disagreements_only:
        rows = rows.where("corrected_engine")
    parts = ["table_name", "column", "is_pii", "entity_type", "classification", "logical_type", "confidence", "source"]
    context = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]), 256)
    return rows.withColumn("context_hash", context).dropDuplicates(["context_hash"])


def training_audit(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_pii").alias("pii"), F.count_if("corrected_engine").alias("corrected"),
                    F.count_if(F.col("corrected_engine").isNull()).alias("unknown_baseline"), F.count_distinct("table_name").alias("tables"))


# fixed values: fields that carry raw values, and shapes of personal values inside text
FORBIDDEN_FIELDS = ["samples", "sample_values", "values", "raw", "text", "text_context", "examples", "example_values", "top_values"]
SAFE_FIELDS = ["context_hash", "format_signatures", "decision_rule", "decided_at", "reviewed_at", "created_at", "ts", "run_id", "checksum", "version", "review_digest"]
RAW_SHAPES = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"(?<![\w-])\+?\d[\d\s\-()]{8,}\d(?![\w-])", r"\b\d{10,}\b"]


def portable_violations(df: DataFrame, id_column: str) -> DataFrame:
    """Rows that must not leave: a filled raw-value field, or a personal value inside a text field."""
    found = []
    for f in df.schema.fields:
        if f.name == id_column or f.name in SAFE_FIELDS:
            continue
        text = F.to_json(F.struct(col(f.name).alias("v")))
        if f.name in FORBIDDEN_FIELDS:
            found.append(F.when(col(f.name).isNotNull() & ~text.isin('{"v":""}', '{"v":[]}', '{"v":{}}', "{}"), F.struct(F.lit(f.name).alias("field"), F.lit("raw field").alias("reason"))))
        elif f.dataType.simpleString() not in ("boolean", "double", "float", "int", "bigint", "smallint", "tinyint"):
            hit = F.lit(False)
            for shape in RAW_SHAPES:
                hit = hit | text.rlike(shape)
            stamp = text.rlike(r'^\{"v":"\d{4}-\d{2}-\d{2}T')
            found.append(F.when(hit & ~stamp, F.struct(F.lit(f.name).alias("field"), F.lit("personal value").alias("reason"))))
    return df.select(col(id_column), F.inline(F.array_compact(F.array(*found))))


# fixed values: shapes scrubbed from business text, in order, with what replaces them
SCRUB = [(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[email redacted]"), (r"\b\+?\d[\d\s\-()]{8,}\d\b", "[phone redacted]"),
         (r"\b\d{10,}\b", "[identifier redacted]")]


def scrub(c: Column) -> Column:
    for rx, to in SCRUB:
        c = F.regexp_replace(c, rx, to)
    return c


def residual(c: Column) -> Column:
    """True when a scrubbed text still carries a personal value."""
    hit = F.lit(False)
    for rx, _ in SCRUB:
        hit = hit | c.rlike(rx)
    return hit


UNITS = {"d": "DAY", "m": "MONTH", "y": "YEAR", "h": "HOUR"}


def read_retention(docs: DataFrame) -> DataFrame:
    """Retention of contract documents (JSON text in ``doc``): value, unit, driver, element, NA when unset."""
    entry = "array<struct<property:string,value:string,unit:string,driver:string,element:string>>"
    sla = F.filter(F.from_json(F.get_json_object("doc", "$.slaProperties"), entry), lambda e: e["property"] == "retention")
    e = F.get(sla, F.lit(0))
    return docs.select(F.get_json_object("doc", "$.name").alias("name"), F.coalesce(e["value"], F.lit("NA")).alias("value"), F.coalesce(e["unit"], F.lit("NA")).alias("unit"),
                       e["driver"].alias("driver"), e["element"].alias("element"), e.isNotNull().alias("is_set"))


def retention(df: DataFrame, element: str, value: int, unit: str, as_of: str, expired: bool = False) -> DataFrame:
    """Rows within their retention (or the expired ones): one range filter that reaches the scan."""
    limit = F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {int(value)} {UNITS[unit]}")
    old = col(element) < limit
    return df.where(old if expired else ~old)


def listing(index: DataFrame, text: str = "", status: str | None = None, sort: str = "name", descending: bool = False, limit: int = 50,
            offset: int = 0) -> DataFrame:
    """A page of an index: search text, filter, order, and the total number of hits."""
    hits = index
    if text:
        hits = hits.where(F.contains(F.lower("name"), F.lit(text.lower())))
    if status is not None:
        hits = hits.where(F.col("status") == status)
    order = col(sort).desc() if descending else col(sort).asc()
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    page = hits.orderBy(order, "name").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total))      # one row


__all__ = ["schema", "columns", "effective", "attach", "contract_diff", "diff_summary", "span_diff", "variants", "training", "training_audit",
           "portable_violations", "scrub", "residual", "read_retention", "retention", "listing", "fingerprint_key"]

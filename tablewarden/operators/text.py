"""Personal data in free text: candidate spans, context rules, arbitration and resolution.

A span row is ``doc_id, start, end, entity_type, score, engine, recognizer, validator, is_proposal, canonical,
surface, before, after``; ``before`` / ``after`` hold the characters around the span so later steps do not join
the documents again.  Offsets are code points.  Order-dependent steps fold over the spans of one overlap cluster,
which is bounded by a stretch of one document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tablewarden.functions import checks as C
from tablewarden.functions import text as X
from tablewarden.functions import text_values as V
from tablewarden.functions.columns import computed_once, let, lit_map, ratio, spread
from tablewarden.functions.spans import SPANS, context, count_matches, find_spans, interval_join, overlaps, parts
from tablewarden.operators.detect import canonical_entity, catalog, java_regex, may_match

CONTEXT = 120
HINT_RADIUS = 40
SPAN_COLUMNS = ["doc_id", "start", "end", "entity_type", "score", "engine", "recognizer", "validator", "is_proposal",
                "canonical", "surface", "before", "after"]
_SHAPE = ("struct<start:int,end:int,surface:string,entity_type:string,score:double,engine:string,recognizer:string,"
          "validator:string,is_proposal:boolean,canonical:string>")


def _tagged(found: Column, entity: str, score: Column | float, engine: str, recognizer: str, validator: str | None = None,
            canonical: Callable[[Column], Column] | None = None) -> Column:
    return F.transform(F.coalesce(found, F.array().cast(SPANS)), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["surface"].alias("surface"), F.lit(entity).alias("entity_type"),
        (F.lit(float(score)) if not isinstance(score, Column) else score).alias("score"), F.lit(engine).alias("engine"),
        F.lit(recognizer).alias("recognizer"), F.lit(validator).cast("string").alias("validator"),
        F.lit(False).alias("is_proposal"), (canonical(s["surface"]) if canonical else s["surface"]).alias("canonical")).cast(_SHAPE))


def _explode(docs: DataFrame, candidates: Sequence[Column]) -> DataFrame:
    """One pass over the documents: all candidate arrays of a row, glued and exploded, with their context."""
    empty = F.array().cast(f"array<{_SHAPE}>")
    # the generator keeps the text in the row exactly once while its matches fan out
    rows = docs.select("doc_id", "text", F.explode(F.concat(empty, *candidates)).alias("s"))
    before, after = context(F.col("text"), F.col("s.start"), F.col("s.end"), CONTEXT)
    return rows.select("doc_id", "s.*", before.alias("before"), after.alias("after")).select(*SPAN_COLUMNS)


def _window(radius: int) -> Column:
    return F.lower(F.concat_ws(" ", F.substring("before", -radius, radius), "surface", F.substring("after", 1, radius)))


def near(labels: Sequence[str], window: str = "_window") -> Column:
    """Whether any label stands in the lower-cased window column."""
    return reduce(lambda a, b: a | b, [F.col(window).contains(x.lower()) for x in labels], F.lit(False))


# --- candidates ------------------------------------------------------------------------------------------

def regex_candidates(text: Column, lowered: Column, patterns: Sequence[dict[str, Any]] | None = None) -> list[Column]:
    out = []
    for p in patterns or [p for p in catalog() if p["group"] == "free_text"]:
        found = F.when(may_match(p, text, lowered), find_spans(text, java_regex(p)))
        if p["validator"]:
            found = _validated(found, p["validator"])
        out.append(_tagged(found, p["entity_type"], p["validated_score"] or p["score"] if p["validator"] else p["score"],
                           "regex", p["pattern_name"], p["validator"]))
    return out


def _validated(found: Column, kind: str) -> Column:
    check = C.VALIDATORS[kind]
    return F.filter(found, lambda s: check(s["surface"]))


def regex_spans(docs: DataFrame, patterns: Sequence[dict[str, Any]] | None = None) -> DataFrame:
    """Spans of the free-text patterns; a hint near a span raises its score a little."""
    pats = list(patterns or [p for p in catalog() if p["group"] == "free_text"])
    texts = computed_once(spread(docs.select("doc_id", "text"), "doc_id"), _lowered=F.lower("text"))
    spans = _explode(texts, regex_candidates(F.col("text"), F.col("_lowered"), pats)).withColumn("entity_type", canonical_entity(F.col("entity_type")))
    by_entity: dict[str, set[str]] = {}
    for p in catalog():
        by_entity.setdefault(p["entity_type"], set()).update(p["hints"].split())
    spans = computed_once(spans, _window=_window(HINT_RADIUS))
    hit = F.lit(False)
    for entity in sorted({p["entity_type"] for p in pats}):
        hit = F.when(F.col("entity_type") == entity, near(sorted(by_entity.get(entity, ())))).otherwise(hit)
    return spans.withColumn("score", F.when(hit, F.least(F.lit(1.0), F.col("score") + 0.05)).otherwise(F.col("score"))).drop("_window")


def entity_counts(docs: DataFrame, patterns: Sequence[dict[str, Any]] | None = None) -> DataFrame:
    """Matches per (document, pattern) without building spans."""
    pats = list(patterns or [p for p in catalog() if p["group"] == "free_text"])
    entries = [F.struct(F.lit(p["entity_type"]).alias("entity_type"), F.lit(p["pattern_name"]).alias("pattern_name"),
                        F.when(may_match(p, F.col("text"), F.col("_lowered")), count_matches(F.col("text"), java_regex(p))).alias("n")) for p in pats]
    texts = computed_once(spread(docs.select("doc_id", "text"), "doc_id"), _lowered=F.lower("text"))
    return texts.select("doc_id", F.inline(F.filter(F.array(*entries), lambda e: e["n"] > 0)))


PHONE_SHAPE = r"(?<![\w+])\+?\d[\d\s().\-]{6,18}\d(?!\w)"


def phone_spans(docs: DataFrame, region: str = "EG") -> DataFrame:
    found = find_spans(F.col("text"), PHONE_SHAPE)
    valid = F.filter(found, lambda s: C.phone(s["surface"], region)["valid"])
    return _explode(spread(docs.select("doc_id", "text"), "doc_id"), [_tagged(valid, "PHONE_NUMBER", 0.85, "phone", "numbering_plan", "phone", C.digits_of)])


# --- expanders: written forms that plain patterns miss -----------------------------------------------------

_D = r"[\d٠-٩۰-۹]"
_digits = lambda c: C.digits_of(X.fold_digits(c))


def digit_cluster(text: Column) -> list[Column]:
    found = find_spans(text, rf"(?U)(?<!\w)\+?{_D}(?:[\d٠-٩۰-۹\s\-–—./_]{{6,30}}{_D})(?!\w)")
    sized = F.filter(found, lambda s: F.length(_digits(s["surface"])).between(8, 20))
    return [_tagged(sized, "DIGITS", 0.5, "preprocess", "digit_cluster", None, _digits)]


def parenthesized_digits(text: Column) -> list[Column]:
    run = rf"\(\s*{_D}{{1,4}}\s*\)(?:\s*\(\s*{_D}{{1,4}}\s*\)){{2,}}|\(\s*{_D}{{8,20}}\s*\)"
    sized = F.filter(find_spans(text, rf"(?U)(?<!\w)(?:{run})(?!\w)"), lambda s: F.length(_digits(s["surface"])) >= 8)
    short = find_spans(text, rf"(\(\s*)({_D}{{3,4}})(\s*\))", parts())
    return [_tagged(sized, "DIGITS", 0.5, "preprocess", "parenthesized_digits", None, _digits),
            _tagged(short, "CVV", 0.5, "preprocess", "parenthesized_digits", None, _digits)]


AT = r"(?:\s*@\s*|\s*[(\[]\s*at\s*[)\]]\s*|\s+at\s+|\s+آت\s+)"
DOT = r"(?:\s*\.\s*|\s*[(\[]\s*dot\s*[)\]]\s*|\s+dot\s+|\s+نقطة\s+|\s+دوت\s+)"


def spaced_email(text: Column) -> list[Column]:
    """``name at host dot com`` and ``name @ host . com``; clean addresses are left to the pattern."""
    found = find_spans(text, rf"(?i)(?<![\w.])[A-Za-z0-9._%+\-]{{1,64}}{AT}[A-Za-z0-9\-]{{1,63}}(?:{DOT}[A-Za-z0-9\-]{{2,63}}){{1,3}}(?!\w)")
    odd = F.filter(found, lambda s: ~s["surface"].rlike(r"^[^\s@]+@[^\s@]+$") & s["surface"].rlike(r"(?i)(\.|dot|نقطة|دوت)\W*[A-Za-z]{2,}$"))
    canon = lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, f"(?i){AT}", "@"), f"(?i){DOT}", "."), r"\s", ""))
    return [_tagged(odd, "EMAIL_ADDRESS", 0.75, "preprocess", "spaced_email", "email_shape", canon)]


def age_phrase(text: Column) -> list[Column]:
    forms = [r"(?i)((?<!\w)(?:age|aged)\s*[:=]?\s*)(\d{1,3})(\s*(?:years?|yrs?)?(?!\w))", r"(?i)((?<!\w))(\d{1,3})(\s*(?:years?\s*old|yrs?\s*old)(?!\w))",
             r"((?<!\w)(?:عمري|سني|عمره|سنها|عنده|عندها|عمر)\s*[:=]?\s*)(\d{1,3})(\s*(?:سنة|سنه|سنوات)?)", r"((?<!\w))(\d{1,3})(\s*(?:سنة|سنه|سنوات)(?!\w))"]
    both = F.array_distinct(F.concat(*[F.coalesce(find_spans(text, f, parts()), F.array().cast(SPANS)) for f in forms]))
    sane = F.filter(both, lambda s: s["surface"].try_cast("int").between(1, 120))
    return [_tagged(sane, "AGE", 0.7, "preprocess", "age_phrase", "age_range", lambda c: c.try_cast("int").cast("string"))]


_WORDS = {w: d for d, ws in V.SPOKEN.items() for w in ws.split()}
_PLURALS = {w: d for d, ws in V.SPOKEN_PLURALS.items() for w in ws.split()}


def spoken_value(surface: Column) -> Column:
    """Number words → digits: units append, tens join a preceding unit over "and", "four fives" repeats."""
    tokens = F.filter(F.split(F.lower(surface), r"[\s,،/\-–—]+"), lambda w: w != "")
    words, plurals = lit_map(_WORDS), lit_map(_PLURALS)

    def step(acc: Column, tok: Column) -> Column:
        joined = tok.startswith("و") & F.try_element_at(words, tok).isNull()
        bare = F.when(joined, F.substr(tok, F.lit(2))).otherwise(tok)
        code, many = F.try_element_at(words, bare), F.try_element_at(plurals, bare)
        ten = joined & (F.length(code) == 2) & code.endswith("0") & (F.length(acc["unit"]) == 1)
        repeat = F.repeat(many, F.coalesce(acc["unit"].try_cast("int"), F.lit(1)))
        cut = F.when((F.length(acc["unit"]) == 1) & (ten | many.isNotNull()), F.substr(acc["out"], F.lit(1), F.length(acc["out"]) - 1)).otherwise(acc["out"])
        out = F.when(ten, F.concat(cut, F.substring(code, 1, 1), acc["unit"])).when(many.isNotNull(), F.concat(cut, repeat)) \
            .otherwise(F.concat(acc["out"], F.coalesce(code, F.when(bare.rlike("^[0-9]+$"), bare), F.lit(""))))
        return F.struct(out.alias("out"), F.when(~ten, code).alias("unit"))
    zero = F.struct(F.lit("").alias("out"), F.lit(None).cast("string").alias("unit"))
    return F.aggregate(tokens, zero, step, lambda acc: acc["out"])


def one_of(words: Sequence[str]) -> str:
    """A regex for any of the words, grouped by what they begin with: a text's word meets one branch, not every word in turn.

    What follows must end the match (such as ``(?!\\w)``): of words that begin alike the longest is tried first.
    """
    heads: dict[str, set[str]] = {}
    for w in words:
        heads.setdefault(w[0], set()).add(w[1:])
    branches = []
    for head, rests in sorted(heads.items()):
        rest = one_of([r for r in rests if r])
        branches.append(re.escape(head) + (f"(?:{rest}){'?' if '' in rests else ''}" if rest else ""))
    return "|".join(branches)


def spoken_digits(text: Column) -> list[Column]:
    alternatives = one_of([*_WORDS, *_PLURALS])
    word = rf"(?:و?(?:{alternatives})|\d)(?!\w)"
    found = find_spans(text, rf"(?iU)(?<!\w){word}(?:[\s,،/\-–—]+{word}){{2,}}")
    long = F.filter(found, lambda s: F.length(spoken_value(s["surface"])) >= 3)
    return [_tagged(long, "DIGITS", 0.5, "preprocess", "spoken_digits", None, spoken_value)]


EXPANDERS: dict[str, Callable[[Column], list[Column]]] = {
    "digit_cluster": digit_cluster, "parenthesized_digits": parenthesized_digits, "spaced_email": spaced_email,
    "age_phrase": age_phrase, "spoken_digits": spoken_digits}
PRODUCERS: dict[str, Callable] = {}


def register_expander(name: str, fn: Callable[[Column], list[Column]]) -> None:
    """Add an expander: a function from the text Column to arrays of candidate structs."""
    EXPANDERS[name] = fn


def register_spans(name: str, fn: Callable) -> None:
    """Add an external span producer: an iterator of pandas batches (doc_id, text) to batches of spans."""
    PRODUCERS[name] = fn


def produced_spans(docs: DataFrame, name: str) -> DataFrame:
    """Spans of a registered producer; a model it loads is loaded once per task, not per batch."""
    out = docs.select("doc_id", "text").mapInPandas(PRODUCERS[name], "doc_id bigint, start int, end int, entity_type string, score double")
    joined = out.join(docs.select("doc_id", "text"), "doc_id")
    before, after = context(F.col("text"), F.col("start"), F.col("end"), CONTEXT)
    surface = F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return joined.select("doc_id", "start", "end", "entity_type", "score", F.lit("ner").alias("engine"), F.lit(name).alias("recognizer"),
                         F.lit(None).cast("string").alias("validator"), F.lit(False).alias("is_proposal"), surface.alias("canonical"),
                         surface.alias("surface"), before.alias("before"), after.alias("after"))


def expand(docs: DataFrame, *names: str) -> DataFrame:
    return _explode(spread(docs.select("doc_id", "text"), "doc_id"), [c for n in (names or EXPANDERS) for c in EXPANDERS[n](F.col("text"))])


def route(spans: DataFrame, region: str = "EG") -> DataFrame:
    """Digit runs → phone, national id, IMEI, IMSI, ICCID or card, by label, checksum and length."""
    d, n = F.col("canonical"), F.length("canonical")
    raw = F.col("entity_type") == "DIGITS"
    hint = F.lit(None).cast("string")
    for entity, labels in reversed(V.LABELS):
        hint = F.when(near(labels), entity).otherwise(hint)
    seen = computed_once(spans, _window=_window(80))
    # every checksum runs once per digit run, and only on the lengths it can hold for
    seen = computed_once(
        seen, _label=hint, _cvv=near(V.CVV_LABELS),
        _phone=raw & n.between(8, 15) & (C.phone(d, region)["valid"] | C.msisdn_egypt(d).isNotNull()),
        _nid=raw & (n == 14) & C.VALIDATORS["egypt_nid"](d), _iccid=raw & n.between(19, 20) & C.iccid(d),
        _imei=raw & (n == 15) & C.VALIDATORS["imei"](d), _imsi=raw & n.between(14, 15) & C.VALIDATORS["imsi"](d),
        _card=raw & n.between(13, 19) & C.luhn(d))
    checks = {"PHONE_NUMBER": ("_phone", 0.92), "EG_NATIONAL_ID": ("_nid", 0.93), "ICCID": ("_iccid", 0.93), "IMEI": ("_imei", 0.92),
              "IMSI": ("_imsi", 0.90), "CREDIT_CARD": ("_card", 0.90)}
    lengths = {"EG_NATIONAL_ID": n.between(12, 15), "IMEI": n == 15, "PHONE_NUMBER": n.between(8, 13), "CREDIT_CARD": n.between(13, 19)}

    def choice(e: str, s: float, v: str | None, p: bool) -> Column:
        return F.struct(F.lit(e).alias("e"), F.lit(s).alias("s"), F.lit(v).cast("string").alias("v"), F.lit(p).alias("p"))
    pick = F.when(F.col("entity_type") == "CVV", F.when(F.col("_cvv"), choice("CVV", 0.75, None, True)))
    pick = pick.when(~raw, F.struct(F.col("entity_type").alias("e"), F.col("score").alias("s"), F.col("validator").alias("v"), F.col("is_proposal").alias("p")))
    for entity, _ in V.LABELS:                                                                # with a label
        ok, score = checks[entity]
        pick = pick.when((F.col("_label") == entity) & F.col(ok), choice(entity, score, entity.lower(), False))
        if entity in lengths:
            pick = pick.when((F.col("_label") == entity) & lengths[entity], choice(entity, 0.45, None, True))
    for entity in ("PHONE_NUMBER", "EG_NATIONAL_ID", "ICCID", "IMEI", "IMSI", "CREDIT_CARD"):   # without one
        ok, score = checks[entity]
        pick = pick.when(F.col(ok), choice(entity, score, entity.lower(), False))
    keep = [c for c in SPAN_COLUMNS if c not in ("entity_type", "score", "validator", "is_proposal")]
    return seen.select(*keep, F.explode(F.array_compact(F.array(pick))).alias("_p")).select(
        *keep, F.col("_p.e").alias("entity_type"), F.col("_p.s").alias("score"), F.col("_p.v").alias("validator"),
        F.col("_p.p").alias("is_proposal")).select(*SPAN_COLUMNS)


# --- span rules ------------------------------------------------------------------------------------------

def islands(spans: DataFrame, keys: Sequence[str], gap: int = 0) -> DataFrame:
    """Number runs of spans that overlap or lie within ``gap`` characters, per key, as ``cluster``."""
    w = W.partitionBy(*keys).orderBy("start", F.col("end").desc())
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    apart = F.col("start") >= reach if gap == 0 else F.col("start") > reach + gap
    fresh = F.when(reach.isNull() | apart, 1).otherwise(0)
    return spans.withColumn("_new", fresh).withColumn("cluster", F.sum("_new").over(
        w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_new")


def clusters(spans: DataFrame) -> DataFrame:
    return islands(spans, ["doc_id"])


def merge_equivalent(spans: DataFrame, gap: int = 3) -> DataFrame:
    """Same entity, same canonical value, touching or nearly so → one wider span."""
    merging = ~F.col("entity_type").isin(V.KEEP_BOTH) & (F.coalesce("canonical", F.lit("")) != "")
    alone = F.concat_ws("|", "start", "end", "engine", "recognizer")
    keys = ["doc_id", "entity_type", "_key"]
    runs = islands(spans.withColumn("_key", F.when(merging, F.concat(F.lit("="), F.col("canonical"))).otherwise(alone)), keys, gap)
    size = F.col("end") - F.col("start")
    best = F.struct(F.when(F.col("validator").isNotNull(), 1).otherwise(0), "score", size)
    return runs.groupBy(*keys, "cluster").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"), F.max_by("engine", best).alias("engine"),
        F.array_join(F.array_sort(F.collect_set("recognizer")), "|").alias("recognizer"), F.max("validator").alias("validator"),
        F.every("is_proposal").alias("is_proposal"), F.max("canonical").alias("canonical"), F.max_by("surface", F.struct(size)).alias("surface"),
        F.min_by("before", "start").alias("before"), F.max_by("after", "end").alias("after")).select(*SPAN_COLUMNS)


def trim(spans: DataFrame, noise: Sequence[str] = ()) -> DataFrame:
    """Edge punctuation and edge noise words leave the span; empty spans disappear."""
    word = "|".join(noise)
    lead = V.EDGE_LEAD if not noise else rf"^(?:[\s:：=\-–—]+|(?:{word})(?=[\s:,]|$))+"
    tail = V.EDGE_TAIL if not noise else rf"(?:[\s.،,;:!?؟…»«\"']+|(?<=[\s,])(?:{word}))+$"
    fixed = F.col("entity_type").isin(V.NO_TRIM)
    cut = F.length(F.regexp_extract("surface", lead, 0))
    rest = F.substr("surface", cut + 1)
    out = spans.withColumn("_cut", F.when(fixed, 0).otherwise(cut)).withColumn("_rest", F.when(fixed, F.col("surface")).otherwise(rest)) \
        .withColumn("_body", F.when(fixed, F.col("_rest")).otherwise(F.regexp_replace("_rest", tail, "")))
    return out.withColumns({"start": F.col("start") + F.col("_cut"), "end": F.col("start") + F.col("_cut") + F.length("_body"), "surface": F.col("_body")}) \
        .where(F.length("_body") > 0).drop("_cut", "_rest", "_body")


def fold_surface(c: Column) -> Column:
    t = F.translate(F.lower(F.regexp_replace(c, X.ARABIC_MARKS, "")), X.ARABIC_ALEF, X.ARABIC_ALEF_TO)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def exclude(spans: DataFrame, terms: DataFrame, noise: Sequence[str] = (), patterns: Sequence[str] = ()) -> DataFrame:
    """Drop spans whose folded surface is an excluded term (after noise words), or matches a pattern."""
    folded = fold_surface(F.col("surface"))
    bare = F.trim(F.regexp_replace(folded, rf"(?<!\S)(?:{'|'.join(noise)})(?!\S)", "")) if noise else folded
    out = spans.withColumn("_f", F.regexp_replace(bare, r"\s+", " ")).where(F.col("_f") != "")
    for p in patterns:
        out = out.where(~F.col("surface").rlike(p) & ~F.col("_f").rlike(p))
    return out.join(terms.select(fold_surface(F.col("term")).alias("_f")).distinct(), "_f", "left_anti").drop("_f")


def clause_after(text: Column, words: Sequence[str], entity: str, noise: Sequence[str] = ()) -> Column:
    """Spans of the clause behind each cue word: after its separators, to the end of the sentence or speaker's turn, without filler at its end.

    An address counts from its first address word or number on, and does not count without one.
    """
    alternatives = "|".join(sorted(map(re.escape, words), key=len, reverse=True))
    stops = V.SENTENCE_STOPS
    speaker = rf"(?![\n\r]\s*(?:{V.SPEAKERS})\s*:)"
    found = find_spans(text, rf"(?iU)((?<!\w)(?:{alternatives})(?!\w)[ \t:：=\-–—]*)((?:{speaker}[^{stops}])+)()", parts())
    edge = V.EDGE_TAIL

    def cut(s: Column) -> Column:
        skipped = F.greatest(F.regexp_instr(s["surface"], F.lit(V.ADDRESS_HEAD)) - 1, F.lit(0)) if entity in ("LOCATION", "ADDRESS") else F.lit(0)

        def body(skip: Column) -> Column:
            said = F.regexp_replace(F.regexp_replace(F.substr(s["surface"], skip + 1), edge, ""), V.TRAIL_FILLER, "")
            if noise:
                said = F.regexp_replace(said, rf"(?:\s+(?:{'|'.join(map(re.escape, noise))}))+$", "")
            said = F.regexp_replace(said, edge, "")
            begin = s["start"] + skip
            return let(said, lambda t: F.struct(begin.alias("start"), (begin + F.length(t)).alias("end"), t.alias("surface")))
        return let(skipped, body)
    if entity in ("LOCATION", "ADDRESS"):
        found = F.filter(found, lambda s: s["surface"].rlike(V.ADDRESS_HEAD))
    return F.filter(F.transform(found, cut), lambda s: F.trim(s["surface"]) != "")


def extend_context(spans: DataFrame, docs: DataFrame, triggers: dict[str, Sequence[str]], noise: Sequence[str] = ()) -> DataFrame:
    """Spans inside a cue clause (see ``clause_after``) grow to the clause; bare clauses become spans."""
    found = [_tagged(clause_after(F.col("text"), words, entity, noise), entity, 0.86, "preprocess", "context_clause") for entity, words in triggers.items()]
    clauses = _explode(docs, found)
    keyed = clauses.select("doc_id", F.col("entity_type"), F.col("start").alias("cs"), F.col("end").alias("ce"))
    hit = interval_join(spans, keyed, ["doc_id", "entity_type"], "start", "end", "cs", "ce")
    grown = hit.groupBy("doc_id", "entity_type", "cs", "ce").agg(F.max("score").alias("hit_score"), F.max("validator").alias("hit_validator"))
    wide = clauses.join(grown, (clauses.doc_id == grown.doc_id) & (clauses.entity_type == grown.entity_type) & (clauses.start == grown.cs) & (clauses.end == grown.ce), "left") \
        .select(*[clauses[c] for c in SPAN_COLUMNS], "hit_score", "hit_validator") \
        .withColumns({"score": F.greatest("score", F.coalesce("hit_score", F.lit(0.0))), "validator": F.coalesce("validator", "hit_validator")}).select(*SPAN_COLUMNS)
    absorbed = hit.select("doc_id", "entity_type", "start", "end").distinct()
    return spans.join(absorbed, ["doc_id", "entity_type", "start", "end"], "left_anti").select(*SPAN_COLUMNS).unionByName(wide)


def number_policy(spans: DataFrame, units: Sequence[str], cues: dict[str, Sequence[str]]) -> DataFrame:
    """Quantities are dropped, numbers behind a cue are relabelled, short numbers inside an address belong to it."""
    digits = C.digits_of(F.col("surface"))
    unit = "|".join(units)
    quantity = F.ltrim("after").rlike(rf"(?iU)^(?:{unit})(?!\w)") & (F.length(digits).between(1, 6))
    kept = spans.where(~((F.col("entity_type") != "LOCATION") & (digits != "") & quantity))
    label = F.col("entity_type")
    for entity, words in reversed(list(cues.items())):
        label = F.when((digits != "") & F.rtrim(F.regexp_replace("before", r"[:=#\s]+$", "")).rlike(rf"(?iU)(?<!\w)(?:{'|'.join(words)})$"), entity).otherwise(label)
    kept = kept.withColumn("entity_type", label)
    places = kept.where("entity_type = 'LOCATION'").select("doc_id", F.col("start").alias("ls"), F.col("end").alias("le"))
    short = (F.length(digits).between(1, 4)) & F.col("entity_type").isin("PHONE_NUMBER", "EG_NATIONAL_ID", "CREDIT_CARD", "OTP", "AGE")
    house = interval_join(kept.where(short), places, ["doc_id"], "start", "end", "ls", "le").where("start >= ls and end <= le").select("doc_id", "entity_type", "start", "end").distinct()
    return kept.join(house, ["doc_id", "entity_type", "start", "end"], "left_anti").select(*SPAN_COLUMNS)


# fixed values: thresholds of the span equation
REVIEW_MIN, DETECTOR_MIN, BUMP_CAP = 0.82, 0.80, 0.08


def meetings(spans: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``arbitrate`` judges, the same in every mode: spans with the reviews they meet (``_vetoes``, best review ``r``), and reviews that meet no span."""
    det = spans.withColumn("_id", F.xxhash64("doc_id", "start", "end", "entity_type", "engine", "recognizer"))
    rev = reviews.select("doc_id", F.col("start").alias("rs"), F.col("end").alias("re"), F.col("entity_type").alias("rt"),
                         F.col("score").alias("rscore"), "verdict")
    strong, no = F.col("rscore") >= REVIEW_MIN, F.col("verdict") == "NOT_PII"
    same = (F.col("rt") == F.col("entity_type")) & (F.col("rs") == F.col("start")) & (F.col("re") == F.col("end"))
    pairs = interval_join(det, rev, ["doc_id"], "start", "end", "rs", "re").groupBy("_id").agg(
        F.struct(F.max(F.when(no, strong & (F.col("score") < DETECTOR_MIN))).alias("strict"), F.max(F.when(no, strong)).alias("strong"), F.max(F.when(no, F.lit(True))).alias("any")).alias("_vetoes"),
        F.max(F.when(F.col("verdict") != "NOT_PII", F.struct(same.alias("same"), (F.col("rt") == F.col("entity_type")).alias("type"),
                                                             F.col("rscore").alias("s"), F.col("rt").alias("t"), F.col("rs").alias("a"), F.col("re").alias("b")))).alias("r"))
    positive = rev.where("verdict <> 'NOT_PII'")
    met = interval_join(positive.select("doc_id", "rs", "re").distinct(), det.select("doc_id", "start", "end").distinct(), ["doc_id"], "rs", "re", "start", "end")
    return det.join(pairs, "_id", "left"), positive.join(met.select("doc_id", "rs", "re").distinct(), ["doc_id", "rs", "re"], "left_anti")


def arbitrate(spans: DataFrame, reviews: DataFrame, mode: str = "balanced", docs: DataFrame | None = None, met: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Detector spans against a second source (doc_id, start, end, entity_type, score, verdict PII / NOT_PII).

    Adds ``agreement`` and ``rule``.  A validated span never shrinks and is never vetoed.  A span widens inside its sentence of the text in ``docs``
    (doc_id, text), and its surface, canonical form and context are read from there again; without ``docs`` the stored context is all that is known.
    ``met``: what ``meetings`` gave for these spans and reviews, if several modes share it.
    """
    j, lone = met or meetings(spans, reviews)
    veto = {"independent": F.lit(False), "strict": F.col("_vetoes.strict"), "balanced": F.col("_vetoes.strong"), "lenient": F.col("_vetoes.any")}[mode]
    j = j.withColumn("vetoed", veto)
    validated, r = F.col("validator").isNotNull(), F.col("r")
    gone = F.coalesce(F.col("vetoed"), F.lit(False)) & ~validated
    second = {"independent": F.lit(False), "strict": F.lit(False), "balanced": r["s"] >= REVIEW_MIN, "lenient": F.lit(True)}[mode] & ~validated
    conflict = r.isNotNull() & ~r["type"]
    bump = F.greatest(F.lit(0.0), (r["s"] - F.col("score")) * 0.5)
    bump = F.least(F.lit(BUMP_CAP), F.when(bump > 0, bump).otherwise(0.03))
    widen = F.lit(mode in ("balanced", "lenient")) & r.isNotNull() & r["type"] & ~r["same"]
    # widening stays inside the sentence: the context on either side is cut at sentence marks
    ahead, behind = F.col("before"), F.col("after")
    if docs is not None:
        j = j.withColumn("_widen", F.coalesce(widen, F.lit(False)))
        texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
        j = j.join(texts, (F.col("doc_id") == F.col("_doc")) & F.col("_widen"), "left")
        ahead = F.coalesce(F.substr("_text", F.lit(1), F.col("start")), ahead)
        behind = F.coalesce(F.substr("_text", F.col("end") + 1), behind)
    left_room = F.length(F.regexp_extract(ahead, r"[^.!?؟\n]*$", 0))
    right_room = F.length(F.regexp_extract(behind, r"^[^.!?؟\n]*", 0))
    start = F.when(widen, F.greatest(F.least("start", r["a"]), F.col("start") - left_room)).otherwise(F.col("start"))
    end = F.when(widen, F.least(F.greatest("end", r["b"]), F.col("end") + right_room)).otherwise(F.col("end"))
    agreement = F.when(gone, "vetoed").when(r.isNull(), "unconfirmed").when(r["same"], "confirmed").when(conflict, "type_conflict").otherwise("boundary_conflict")
    rule = F.when(gone, "veto_unvalidated").when(r.isNull(), "first_only").when(r["same"], "both_agree") \
        .when(conflict & second, "second_type_wins").when(conflict, "first_type_wins").when(widen, "widened").otherwise("first_extent_kept")
    said = [F.col(c) for c in ("canonical", "surface", "before", "after")]
    if docs is not None:
        surface = F.substr("_text", start + 1, end - start)
        fresh = dict(zip(("surface", "canonical", "before", "after"), (surface, surface, *context(F.col("_text"), start, end, CONTEXT))))
        said = [F.when(F.col("_text").isNotNull(), fresh[c]).otherwise(F.col(c)).alias(c) for c in ("canonical", "surface", "before", "after")]
    kept = j.select(
        "doc_id", start.alias("start"), end.alias("end"), F.when(conflict & second, r["t"]).otherwise(F.col("entity_type")).alias("entity_type"),
        F.when(F.coalesce(r["same"], F.lit(False)), F.least(F.lit(1.0), F.col("score") + bump)).otherwise(F.col("score")).alias("score"),
        "engine", "recognizer", "validator", "is_proposal", *said,
        agreement.alias("agreement"), rule.alias("rule"), (~gone).alias("kept"))
    promoted = {"independent": F.lit(False), "strict": F.lit(False), "balanced": F.col("rscore") >= REVIEW_MIN, "lenient": F.lit(True)}[mode]
    allowed = F.col("rscore") >= REVIEW_MIN if mode == "strict" else F.lit(True)
    none = F.lit(None).cast("string")
    extra = lone.select(
        "doc_id", F.col("rs").alias("start"), F.col("re").alias("end"), F.col("rt").alias("entity_type"), F.col("rscore").alias("score"), F.lit("review").alias("engine"),
        F.lit("review").alias("recognizer"), none.alias("validator"), (~promoted).alias("is_proposal"), none.alias("canonical"), none.alias("surface"), none.alias("before"),
        none.alias("after"), F.lit("second_only").alias("agreement"),
        F.when(~allowed, "second_dropped").when(promoted, "second_promoted").otherwise("second_proposal").alias("rule"), allowed.alias("kept"))
    return kept.unionByName(extra)


def resolve(spans: DataFrame, mode: str = "priority", min_score: float = 0.35, entities: Sequence[str] = ()) -> DataFrame:
    """Non-overlapping winners: validated, then engine priority, then score, then length; ``longest`` puts length first.

    The choice is a fold over the sorted spans of one overlap cluster, so a long document is many small folds.
    """
    pool = spans.where((F.col("score") >= min_score) & (F.col("start") < F.col("end")))
    if entities:
        pool = pool.where(F.col("entity_type").isin(list(entities)))
    if mode == "all":
        return pool.withColumn("losers", F.lit(0))
    priority = F.coalesce(F.try_element_at(lit_map(V.ENGINE_PRIORITY), F.col("engine")), F.lit(0))
    size = F.col("end") - F.col("start")
    rest = [c for c in pool.columns if c not in ("doc_id", "start", "end")]
    order = F.struct(*([(-size).alias("o0")] if mode == "longest" else []), F.when(F.col("validator").isNotNull(), 0).otherwise(1).alias("o1"), (-priority).alias("o2"),
                     (-F.col("score")).alias("o3"), F.col("start").alias("o4"), (-size).alias("o5"), F.col("entity_type").alias("o6"), F.col("recognizer").alias("o7"))
    body = F.struct(order.alias("o"), "start", "end", *rest)
    grouped = clusters(pool).groupBy("doc_id", "cluster").agg(F.array_sort(F.collect_list(body)).alias("s"), F.count(F.lit(1)).alias("n"))
    item = grouped.schema["s"].dataType.simpleString()

    def step(kept: Column, s: Column) -> Column:
        clash = F.exists(kept, lambda k: overlaps(k["start"], k["end"], s["start"], s["end"]))
        return F.when(clash, kept).otherwise(F.array_append(kept, s))
    chosen = F.when(F.col("n") == 1, F.col("s")).otherwise(F.aggregate("s", F.array().cast(item), step))
    flat = grouped.select("doc_id", "s", F.explode(chosen).alias("k"))
    lost = F.size(F.filter("s", lambda x: overlaps(x["start"], x["end"], F.col("k.start"), F.col("k.end")))) - 1
    return flat.select("doc_id", "k.start", "k.end", *[F.col(f"k.{c}") for c in rest], lost.alias("losers"))


# --- long text -------------------------------------------------------------------------------------------

def windows(docs: DataFrame, target: int = 1200, overlap: int = 200) -> DataFrame:
    """Overlapping windows cut at sentence ends, else at white space, else hard; (doc_id, win, start, end, text)."""
    text = F.col("text")
    n = F.length(text)
    least = max(target // 2, overlap + 1)

    def cut(chunk: Column) -> Column:
        sentence = F.length(F.regexp_extract(chunk, r"(?s)^(.*[.!?؟\n])\s", 1))
        space = F.length(F.regexp_extract(chunk, r"(?s)^(.*)\s", 1))
        return F.when(sentence >= least, sentence).when(space >= least, space).otherwise(F.length(chunk))

    def step(acc: Column, _i: Column) -> Column:
        chunk = F.substr(text, acc["pos"] + 1, F.lit(target))
        last = acc["pos"] + target >= n
        end = F.when(last, n).otherwise(acc["pos"] + cut(chunk))
        grown = F.array_append(acc["out"], F.struct(acc["pos"].alias("start"), end.alias("end")))
        return F.when(acc["done"], acc).otherwise(F.struct(
            F.when(last, acc["pos"]).otherwise(end - overlap).cast("int").alias("pos"), last.alias("done"), grown.alias("out")))
    zero = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("done"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    steps = F.sequence(F.lit(0), (n / F.lit(least - overlap)).cast("int"))
    out = F.aggregate(steps, zero, step, lambda acc: acc["out"])
    return spread(docs.where(n > 0).select("doc_id", "text"), "doc_id").select("doc_id", "text", F.posexplode(out).alias("win", "w")).select(
        "doc_id", "win", "w.start", "w.end", F.substr("text", F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("text"))


def rebase(window_spans: DataFrame) -> DataFrame:
    """Spans found in windows (doc_id, win_start, start, end, entity_type, score) → document offsets, best score kept."""
    return window_spans.groupBy("doc_id", (F.col("win_start") + F.col("start")).alias("start"),
                                (F.col("win_start") + F.col("end")).alias("end"), "entity_type").agg(F.max("score").alias("score"))


def clip(docs: DataFrame, n: int) -> DataFrame:
    """The optional length limit of a scan, with what share was scanned."""
    size = F.length("text")
    return docs.select("doc_id", F.substring("text", 1, n).alias("text"), (size > n).alias("truncated"),
                       F.when(size > 0, F.least(size, F.lit(n)) / size).otherwise(1.0).alias("scanned_fraction"))


# --- batch ----------------------------------------------------------------------------------------------

def pending(docs: DataFrame, done: DataFrame) -> DataFrame:
    return docs.join(done.select("doc_id").distinct(), "doc_id", "left_anti")


def report(spans: DataFrame) -> DataFrame:
    """Entity counts and score distribution."""
    return spans.groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("findings"), F.count_distinct("doc_id").alias("documents"), F.min("score").alias("min_score"),
        F.max("score").alias("max_score"), F.avg("score").alias("mean_score"))


def coverage(docs: DataFrame, spans: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Documents scanned, with findings, truncated, and the share of characters scanned."""
    size = F.length("text")
    seen = F.least(size, F.lit(max_chars)) if max_chars else size
    base = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("text").isNull()).alias("errored"),
                    F.count_if(size > seen).alias("truncated"), ratio(F.sum(seen), F.sum(size), 1.0).alias("scanned_fraction"))
    return base.crossJoin(spans.agg(F.count_distinct("doc_id").alias("documents_with_findings"), F.count(F.lit(1)).alias("findings")))


def scan(docs: DataFrame, expanders: Sequence[str] | None = None, reviews: DataFrame | None = None, mode: str = "balanced",
         resolve_mode: str = "priority", min_score: float = 0.35, region: str = "EG", noise: Sequence[str] = (),
         excluded: DataFrame | None = None, triggers: dict[str, Sequence[str]] | None = None,
         units: Sequence[str] = (), cues: dict[str, Sequence[str]] | None = None, producers: Sequence[str] = ()) -> DataFrame:
    """The whole text scan: candidates, routing, merging, rules, arbitration, resolution."""
    written = route(expand(docs, *(expanders or EXPANDERS)), region)
    spans = regex_spans(docs).unionByName(phone_spans(docs, region)).unionByName(written)
    for name in producers:
        spans = spans.unionByName(produced_spans(docs, name))
    spans = trim(merge_equivalent(spans), noise)
    if triggers:
        spans = extend_context(spans, docs, triggers, noise)
    if units or cues:
        spans = number_policy(spans, units or ["^$"], cues or {})
    if excluded is not None:
        spans = exclude(spans, excluded, noise)
    if reviews is not None:
        spans = arbitrate(spans, reviews, mode).where("kept").drop("kept")
    return resolve(spans, resolve_mode, min_score)


# --- guards ----------------------------------------------------------------------------------------------

def _guard(c: Column, patterns: Sequence[str], name: str) -> Column:
    hits = reduce(lambda a, b: a + b, [F.coalesce(c.rlike(f"(?i){p}"), F.lit(False)).cast("int") for p in patterns])
    return F.struct(F.lit(name).alias("name"), (hits > 0).alias("flagged"), F.when(hits > 0, 1.0).otherwise(0.0).alias("score"), hits.alias("hits"))


def injection(c: Column) -> Column:
    return _guard(c, V.INJECTION, "prompt_injection")


def toxicity(c: Column) -> Column:
    return _guard(c, [t if " " in t else rf"\b{t}\b" for t in V.TOXIC], "toxicity")


def action(results: Column, thresholds: dict[str, float] | None = None) -> Column:
    """block / allow with reasons, from an array of guard results."""
    floors = lit_map({"toxicity": 0.75, "prompt_injection": 0.75, **(thresholds or {})})
    bad = F.filter(results, lambda r: r["flagged"] & (r["score"] >= F.coalesce(F.try_element_at(floors, r["name"]), F.lit(0.75))))
    reasons = F.transform(bad, lambda r: F.concat(r["name"], F.lit(": "), r["hits"].cast("string"), F.lit(" match(es)")))
    return F.struct(F.when(F.size(bad) > 0, "block").otherwise("allow").alias("action"), F.array_join(reasons, "; ").alias("reasons"))


def normalize_value(c: Column, entity: Column) -> Column:
    """A value in the form in which two spans of its entity family are compared."""
    edge = r"[.,:;،؛!?؟…·\"'“”‘’«»()\[\]{}<>/ \s]+"
    base = F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), rf"^{edge}|{edge}$", "")
    e = F.upper(entity)
    arabic = F.translate(F.regexp_replace(F.translate(F.lower(F.regexp_replace(base, X.ARABIC_MARKS, "")), X.ARABIC_ALEF, X.ARABIC_ALEF_TO),
                                          "[​‌‍⁠﻿­]", ""), "یى", "يي")
    return F.when(e.isin(V.DIGIT_FAMILY), C.digits_of(X.fold_digits(base))).when(e.isin(V.ARABIC_FAMILY), arabic) \
        .when(e.isin(V.EMAIL_FAMILY + V.ADDRESS_FAMILY), F.regexp_replace(F.lower(base), r"\s+", "")).otherwise(base)


__all__ = ["regex_spans", "entity_counts", "phone_spans", "expand", "route", "merge_equivalent", "trim", "exclude", "extend_context",
           "number_policy", "clusters", "islands", "arbitrate", "resolve", "windows", "rebase", "clip", "pending", "report", "coverage",
           "scan", "injection", "toxicity", "action", "normalize_value", "register_expander", "register_spans"]

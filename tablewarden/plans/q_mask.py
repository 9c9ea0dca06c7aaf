"""Queries of masking and de-identification."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tablewarden.functions import crypto as K
from tablewarden.functions.columns import computed_once, dealt
from tablewarden.functions.text import safe_shape
from tablewarden.operators import mask as M
from tablewarden.operators import text as X
from tablewarden.operators.detect import catalog
from tablewarden.plans.q_detect import CONTACTS_SQL, contacts
from tablewarden.plans.registry import query

MASTER = hashlib.sha256(b"query key").digest()
KEY = K.derive_key(MASTER, "k1")


def hmac_sql(message: str, key: bytes = KEY) -> str:
    block = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def stream_sql(column: str, value: str, block: int = 0) -> str:
    return hmac_sql(f"'{column}|' || {value} || '|{block}'")


def draw_sql(stream: str, i: int, n: int) -> str:
    return f"(('0x' || substr({stream}, {i * 8 + 1}, 8))::BIGINT % {n})"


def _masked(t, *rules):
    return M.apply(contacts(t), list(rules), MASTER)


def _one(name, sql_expr, rule, column="email"):
    """One strategy on one column."""
    @query(name, f"SELECT k, {sql_expr} AS masked FROM {CONTACTS_SQL}" if sql_expr else None)
    def _q(t):
        return _masked(t, rule).select("k", F.col(column).alias("masked"))


@query("k01_apply_plan", f"""
  SELECT k, '***' AS card, left(phone, 2) || repeat('*', length(phone) - 4) || right(phone, 2) AS phone, sha256(host) AS host, device FROM {CONTACTS_SQL}""")
def _q(t):
    return _masked(t, M.MaskRule("card", "redact", {"replacement": "***"}), M.MaskRule("phone", "mask", {"keep_first": 2, "keep_last": 2}),
                   M.MaskRule("host", "hash")).select("k", "card", "phone", "host", "device")


_one("k02_redact", "NULL::VARCHAR", M.MaskRule("email", "redact"))
_one("k03_partial_mask", "CASE WHEN length(email) <= 5 THEN email ELSE left(email, 1) || '####' || right(email, 4) END",
     M.MaskRule("email", "mask", {"keep_first": 1, "keep_last": 4, "mask_char": "#", "preserve_length": False}))
_one("k04_hash", "'h_' || left(sha256(email), 16)", M.MaskRule("email", "hash", {"truncate": 16, "prefix": "h_"}))
_one("k04_hash_md5", "md5(email)", M.MaskRule("email", "hash", {"algo": "md5"}))
_one("k05_keyed_hash", hmac_sql("email"), M.MaskRule("email", "hash", {"hmac_key_ref": "k1"}))


@query("k06_encrypt_round_trip", f"SELECT k, email AS back, true AS prefixed, true AS hidden FROM {CONTACTS_SQL}")
def _q(t):
    e = contacts(t).select("k", "email", K.encrypt(F.col("email"), KEY).alias("c"))
    return e.select("k", K.decrypt(F.col("c"), KEY).alias("back"), F.col("c").startswith("g1:").alias("prefixed"), (~F.contains("c", "email")).alias("hidden"))


def _round_trip(name, column, mode, alphabet, short="error"):
    shape = "[0-9]" if alphabet == "digits" else "[0-9A-Za-z]"

    @query(name, f"SELECT k, {column} AS back, true AS same_shape, true AS changed FROM {CONTACTS_SQL}")
    def _q(t):
        f = computed_once(dealt(contacts(t).select("k", F.col(column).alias("v"))), c=K.fpe(F.col("v"), KEY, alphabet, "tweak", mode, short))
        flat = lambda c: F.regexp_replace(c, shape, "#")
        return f.select("k", K.fpe(F.col("c"), KEY, alphabet, "tweak", mode, short, reverse=True).alias("back"),
                        (flat(F.col("v")) == flat(F.col("c"))).alias("same_shape"), (F.col("v") != F.col("c")).alias("changed"))


_round_trip("k07_keystream_round_trip", "email", "keystream", "alnum")
_round_trip("k08_ff3_round_trip", "card", "ff3", "digits")
_round_trip("k08_ff3_wide_round_trip", "email", "ff3", "alnum", "passthrough")


def _shift_sql(v):
    shifts = ", ".join(str(int.from_bytes(__import__("hmac").new(KEY, f"card:{p}".encode(), hashlib.sha256).digest()[:8], "big") % 10) for p in range(64))
    return f"list_aggregate(list_transform(range(1, length({v}) + 1), lambda i: ((CAST(substr({v}, CAST(i AS INT), 1) AS INT) + [{shifts}][i]) % 10)::VARCHAR), 'string_agg', '')"


_one("k07_keystream", _shift_sql("card"), M.MaskRule("card", "fpe", {"mode": "keystream"}), "card")
_one("k09_position_slice", "left(email, 2) || repeat('*', least(length(email), 6) - 2) || substr(email, 7)",
     M.MaskRule("email", "mask", {"keep_last": 0, "start_index": 2, "end_index": 6}))


@query("k10_keyed_randomness", f"""
  SELECT o_orderkey, {draw_sql(stream_sql('c', 'o_orderpriority'), 0, 1000)}::INTEGER AS a, {draw_sql(stream_sql('c', 'o_orderpriority'), 3, 7)}::INTEGER AS b FROM orders""")
def _q(t):
    s = K.random_hex(F.concat(F.lit("c|"), F.col("o_orderpriority")), KEY)
    return t.orders.select("o_orderkey", K.draw(s, 0, 1000).alias("a"), K.draw(s, 3, 7).alias("b"))


def _pick_sql(pool, stream, i):
    return "list_extract([" + ", ".join(f"'{x}'" for x in pool) + f"], {draw_sql(stream, i, len(pool))} + 1)"


S = "h"
_PEOPLE = f"(SELECT k, email, phone, card, host, {stream_sql('email', 'email')} AS h FROM {CONTACTS_SQL})"


@query("k11_fake_name", f"""
  SELECT k, CASE WHEN {draw_sql(S, 0, 2)} = 1 THEN {_pick_sql(M.EN_FIRST_F, S, 1)} ELSE {_pick_sql(M.EN_FIRST_M, S, 1)} END || ' ' || {_pick_sql(M.EN_LAST, S, 2)} AS masked FROM {_PEOPLE}""")
def _q(t):
    return _masked(t, M.MaskRule("email", "fake", {"kind": "name", "locale": "en"})).select("k", F.col("email").alias("masked"))


@query("k11_fake_address", f"""
  SELECT k, ({draw_sql(S, 0, 299)} + 1)::VARCHAR || ' ' || {_pick_sql(M.EN_STREET, S, 1)} || ', ' || {_pick_sql(M.EN_CITY, S, 2)} AS masked FROM {_PEOPLE}""")
def _q(t):
    return _masked(t, M.MaskRule("email", "fake", {"kind": "address", "locale": "en"})).select("k", F.col("email").alias("masked"))


@query("k11_fake_company", f"SELECT k, {_pick_sql(M.AR_COMPANY, S, 0)} AS masked FROM {_PEOPLE}")
def _q(t):
    return _masked(t, M.MaskRule("email", "fake", {"kind": "company", "locale": "ar"})).select("k", F.col("email").alias("masked"))


@query("k12_fake_phone", f"""
  SELECT k, regexp_replace(phone, '[0-9]', '#', 'g') AS shape, CASE WHEN k % 4 = 3 THEN '' WHEN k % 4 = 1 THEN left(phone, 4) ELSE left(phone, 3) END AS kept FROM {CONTACTS_SQL}""")
def _q(t):
    m = _masked(t, M.MaskRule("phone", "fake", {"kind": "phone", "preserve": {"format": True, "country_code": True}}))
    p = F.col("phone")
    k = F.col("k")
    return m.select("k", F.regexp_replace(p, "[0-9]", "#").alias("shape"),
                    F.when(k % 4 == 3, "").when(k % 4 == 1, F.substring(p, 1, 4)).otherwise(F.substring(p, 1, 3)).alias("kept"))


@query("k13_fake_email", f"""
  SELECT k, {_pick_sql(['user', 'rand', 'anon', 'cust'], S, 0)} || ({draw_sql(S, 1, 99990)} + 10) || '@' || CASE WHEN k % 10 < 9 THEN split_part(email, '@', 2) ELSE {_pick_sql(M.MAIL_HOSTS, S, 3)} END AS masked FROM {_PEOPLE}""")
def _q(t):
    return _masked(t, M.MaskRule("email", "fake", {"kind": "email"})).select("k", F.col("email").alias("masked"))


@query("k13_fake_email_from_name", f"""
  SELECT k, lower(replace(CASE WHEN {draw_sql(S, 0, 2)} = 1 THEN {_pick_sql(M.EN_FIRST_F, S, 1)} ELSE {_pick_sql(M.EN_FIRST_M, S, 1)} END || ' ' || {_pick_sql(M.EN_LAST, S, 2)}, ' ', '.')) || '@' || split_part(email, '@', 2) AS masked
  FROM (SELECT k, email, {stream_sql('name', 'host')} AS h FROM {CONTACTS_SQL}) WHERE k % 10 < 9""")
def _q(t):
    df = contacts(t).where("k % 10 < 9").select("k", F.col("host").alias("name"), "email")
    out = M.apply(df, [M.MaskRule("email", "fake", {"kind": "email"}), M.MaskRule("name", "fake", {"kind": "name", "locale": "en"})], MASTER)
    return out.select("k", F.col("email").alias("masked"))


@query("k14_fake_url", """
  SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)?', 1), '[0-9]', '9', 'g'), '[a-z]', 'a', 'g') AS path_shape
  FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/?#]+/[^/?#]')""")
def _q(t):
    df = t.pages.where(F.col("url").rlike("^[a-z]+://[^/?#]+/[^/?#]"))
    m = M.apply(df.select("page_id", "url"), [M.MaskRule("url", "fake", {"kind": "social_url"})], MASTER)
    u = F.col("url")
    path = F.regexp_extract(u, "^[a-z]+://[^/?#]+(.*)$", 1)
    return m.select("page_id", F.regexp_extract(u, "^([a-z]+://[^/?#]+)", 1).alias("origin"),
                    F.regexp_replace(F.regexp_replace(path, "[0-9]", "9"), "[a-z]", "a").alias("path_shape"))


def _digits_sql(column):
    two = f"{stream_sql(column, column)} || {stream_sql(column, column, 1)}"
    return (f"list_aggregate(list_transform(range(0, length({column})), lambda i: CASE WHEN regexp_matches(substr({column}, CAST(i AS INT) + 1, 1), '[0-9]') "
            f"THEN (('0x' || substr(h, CAST(i AS INT) * 8 + 1, 8))::BIGINT % 10)::VARCHAR ELSE substr({column}, CAST(i AS INT) + 1, 1) END), 'string_agg', '')", two)


_EXPR, _TWO = _digits_sql("card")


@query("k15_fake_digits", f"SELECT k, {_EXPR} AS masked FROM (SELECT k, card, {_TWO} AS h FROM {CONTACTS_SQL})")
def _q(t):
    return _masked(t, M.MaskRule("card", "fake", {"kind": "credit_card"})).select("k", F.col("card").alias("masked"))


@query("k16_date_jitter", f"""
  SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + CAST({draw_sql('h', 0, 61)} - 30 AS INT), '%d/%m/%Y') AS masked
  FROM (SELECT o_orderkey, o_orderdate, {stream_sql('d', "strftime(o_orderdate, '%d/%m/%Y')")} AS h FROM orders)""")
def _q(t):
    df = t.orders.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("d"))
    return M.apply(df, [M.MaskRule("d", "fake", {"kind": "date", "jitter_days": 30})], MASTER).select("o_orderkey", F.col("d").alias("masked"))


@query("k17_fake_uuid", f"""
  SELECT k, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) AS masked FROM {_PEOPLE}""")
def _q(t):
    return _masked(t, M.MaskRule("email", "fake", {"kind": "uuid"})).select("k", F.col("email").alias("masked"))


LONG_REGEX = r"(ab|cd)-[A-F0-9]{4,6}\d{2}x?[a-z]{200}"


@query("k18_fake_regex", f"SELECT k, true AS matches FROM {CONTACTS_SQL}")
def _q(t):
    m = _masked(t, M.MaskRule("email", "fake", {"kind": "regex", "regex_pattern": LONG_REGEX}))
    return m.select("k", F.coalesce(F.col("email").rlike(f"^{LONG_REGEX}$"), F.lit(False)).alias("matches"))


_one("k19_fake_text", "'[redacted]'", M.MaskRule("email", "fake", {"kind": "free_text"}))

SUGGEST_ENTS = ["EG_NATIONAL_ID", "CREDIT_CARD", "IP_ADDRESS", "EMAIL", "JWT_TOKEN", "URL", "PERSON"]


def _suggest_rows(t):
    k = F.col("o_orderkey")
    return t.orders.select(F.concat(F.lit("c"), k.cast("string")).alias("column"),
                           F.element_at(F.array(*[F.lit(x) for x in SUGGEST_ENTS]), (k % 7 + 1).cast("int")).alias("entity_type"), (k % 4 > 0).alias("detected"))


SUGGEST_SQL = f"""(SELECT 'c' || o_orderkey AS "column", o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'passthrough' ELSE
  list_extract(['fpe', 'fpe', 'fpe', 'fake', 'redact', 'passthrough', 'fake'], o_orderkey % 7 + 1) END AS strategy FROM orders)"""


@query("k20_suggest_rules", f'SELECT "column", strategy FROM {SUGGEST_SQL}')
def _q(t):
    return M.suggest(_suggest_rows(t)).select("column", "strategy")


@query("k21_sync_plan", f"""
  SELECT change, count(*) AS n FROM (
    SELECT CASE WHEN p."column" IS NULL THEN 'added' WHEN s."column" IS NULL THEN 'removed' WHEN p.edited THEN 'kept' WHEN p.strategy = s.strategy THEN 'unchanged' ELSE 'updated' END AS change
    FROM (SELECT 'c' || o_orderkey AS "column", CASE WHEN o_orderkey % 5 = 0 THEN 'hash' ELSE 'fpe' END AS strategy, o_orderkey % 3 = 0 AS edited FROM orders WHERE o_orderkey % 10 <> 1) p
    FULL JOIN (SELECT * FROM {SUGGEST_SQL} WHERE k % 10 <> 2) s USING ("column")) GROUP BY 1""")
def _q(t):
    k = F.col("o_orderkey")
    plan = t.orders.where(k % 10 != 1).select(F.concat(F.lit("c"), k.cast("string")).alias("column"), F.when(k % 5 == 0, "hash").otherwise("fpe").alias("strategy"),
                                              F.lit("{}").alias("params"), (k % 3 == 0).alias("edited"))
    rows = _suggest_rows(t).where(F.substring("column", 2, 20).cast("bigint") % 10 != 2)
    return M.sync(plan, rows.select("column"), rows).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("k22_risk_report", f"""
  SELECT 'seg' AS "column", 'high' AS severity, 'Deterministic hash on low-cardinality column' AS issue FROM customer HAVING count(DISTINCT c_mktsegment)::DOUBLE / count(*) < 0.1
  UNION ALL SELECT 'zip_code', 'medium', 'Quasi-identifier passed through'
  UNION ALL SELECT 'name', 'high', 'Legacy keystream FPE'
  UNION ALL SELECT 'seg2', 'high', 'FPE leaves values unchanged' UNION ALL SELECT 'seg2', 'low', 'Reversible strategy (fpe)'
  UNION ALL SELECT 'note', 'medium', 'Free-text not redacted'""")
def _q(t):
    df = t.customer.select(F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("zip_code"), F.col("c_name").alias("name"),
                           F.col("c_mktsegment").alias("seg2"), F.col("c_name").alias("note"))
    return M.risk(df, [M.MaskRule("seg", "hash"), M.MaskRule("zip_code"), M.MaskRule("name", "fpe", {"mode": "keystream"}), M.MaskRule("seg2", "fpe"),
                       M.MaskRule("note", "fake", {"kind": "free_text", "redact": False})]).select("column", "severity", "issue")


@query("k23_compare_and_manifest", """
  SELECT 'sample' AS part, least(20, count(*)) AS n, true AS right FROM customer UNION ALL SELECT 'manifest email hash', 1, true UNION ALL SELECT 'manifest card fpe', 1, true""")
def _q(t):
    plan = [M.MaskRule("email", "hash", {"truncate": 8}), M.MaskRule("card", "fpe", {"key_ref": "k1"})]
    side = M.compare(contacts(t), plan, MASTER, 20)
    right = (F.col("email.masked") == F.substring(F.sha2("email.original", 256), 1, 8)) & (F.col("card.masked") != F.col("card.original")) & (F.length("card.masked") == F.length("card.original"))
    shown = side.agg(F.lit("sample").alias("part"), F.count(F.lit(1)).alias("n"), F.every(right).alias("right"))
    clean = ~F.to_json(F.struct("params")).contains(MASTER.hex())
    listed = M.manifest(plan, t.spark).groupBy("column", "strategy").agg(F.count(F.lit(1)).alias("n"), F.every(clean).alias("right"))
    return shown.unionByName(listed.select(F.concat_ws(" ", F.lit("manifest"), "column", "strategy").alias("part"), "n", "right"))


EMAIL_SPAN = r"(^|[^\pL\pN_])([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})"


@query("k24_deid_text", f"SELECT doc_id, regexp_replace(text, '{EMAIL_SPAN}', '\\1[EMAIL_ADDRESS]', 'g') AS text FROM documents")
def _q(t):
    spans = X.resolve(X.regex_spans(t.documents, [p for p in catalog() if p["pattern_name"] == "scan_email"]))
    return M.deid_text(t.documents.select("doc_id", "text"), spans, {}, MASTER).select("doc_id", "text")


@query("k24_deid_text_hashed", f"""
  SELECT o_orderkey AS doc_id, 'Write to <' || left(sha256('u' || o_orderkey || '@mail.com'), 8) || '> or [IP_ADDRESS] now' AS text FROM orders""")
def _q(t):
    k = F.col("o_orderkey").cast("string")
    docs = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Write to <u"), k, F.lit("@mail.com> or 10.0.0.7 now")).alias("text"))
    spans = X.resolve(X.regex_spans(docs, [p for p in catalog() if p["pattern_name"] in ("scan_email", "scan_ipv4")]))
    return M.deid_text(docs, spans, {"EMAIL_ADDRESS": M.MaskRule("*", "hash", {"truncate": 8})}, MASTER).select("doc_id", "text")


@query("k25_deid_columns", f"SELECT k, sha256(email) AS email, '[PHONE_NUMBER]' AS phone, host FROM {CONTACTS_SQL}")
def _q(t):
    c = contacts(t)
    ev = t.spark.createDataFrame([("email", "EMAIL", True), ("phone", "PHONE", True), ("host", "IP_ADDRESS", False)], "column string, entity_type string, detected boolean")
    return M.deid_columns(c, ev, {"EMAIL_ADDRESS": M.MaskRule("*", "hash")}, MASTER).select("k", "email", "phone", "host")


@query("k26_resolve_policy", """
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND (o_orderkey % 10) / 10.0 >= 0.5 THEN 'fake' WHEN o_orderkey % 3 = 1 THEN 'fpe' ELSE 'redact' END AS strategy FROM orders""")
def _q(t):
    k = F.col("o_orderkey")
    found = t.orders.select("o_orderkey", F.when(k % 3 == 0, "PERSON").when(k % 3 == 1, "CREDIT_CARD").otherwise("OTHER").alias("entity_type"), ((k % 10) / 10.0).alias("score"))
    over = t.spark.createDataFrame([("person", "fake", 0.5), ("credit_card", "fpe", 0.0)], "entity_type string, strategy string, min_score double")
    return M.rule_for(found, over).select("o_orderkey", "strategy")


@query("k27_safe_shapes", """
  SELECT p_partkey, 'n' || length(p_brand) || ':' || regexp_replace(regexp_replace(p_brand, '[A-Za-z]', 'L', 'g'), '[0-9]', 'D', 'g') AS shape FROM part""")
def _q(t):
    return t.part.select("p_partkey", safe_shape(F.col("p_brand")).alias("shape"))



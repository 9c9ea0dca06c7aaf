"""Queries of column discovery: patterns, validators, rates, geography, verdicts and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.functions import checks as C
from tablewarden.functions import pattern_values as V
from tablewarden.functions import text as X
from tablewarden.functions.conditions import condition
from tablewarden.operators import detect as P
from tablewarden.plans.registry import query


def luhn_sql(x: str) -> str:
    """Luhn over the digits of a SQL text expression."""
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    digit = f"CAST(substr({d}, CAST(i AS INT), 1) AS INT)"
    return (f"(length({d}) > 0 AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 1 "
            f"THEN CASE WHEN 2 * {digit} > 9 THEN 2 * {digit} - 9 ELSE 2 * {digit} END ELSE {digit} END)) % 10 = 0)")


# --- contacts: text columns derived from customers, the same in both engines --------------------------------
CONTACTS_SQL = """
  (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 < 9 THEN 'user' || c_custkey || '@mail' || (c_custkey % 7) || '.example.com' ELSE c_name END AS email,
          CASE c_custkey % 4 WHEN 0 THEN '010' || lpad(c_custkey::VARCHAR, 8, '0') WHEN 1 THEN '+2011' || lpad(c_custkey::VARCHAR, 8, '0')
               WHEN 2 THEN '002012' || lpad(c_custkey::VARCHAR, 8, '0') ELSE 'n/a' || c_custkey END AS phone,
          '10.0.' || (c_custkey % 256) || '.' || (c_custkey % 200) AS host,
          lpad((c_custkey * 7919)::VARCHAR, 15, '35') AS device, lpad((c_custkey * 104729 + 4539578763621486)::VARCHAR, 16, '4') AS card
   FROM customer)"""


def contacts(t):
    k = F.col("c_custkey")
    s = k.cast("string")
    return t.customer.select(
        k.alias("k"), F.when(k % 10 < 9, F.concat(F.lit("user"), s, F.lit("@mail"), (k % 7).cast("string"), F.lit(".example.com"))).otherwise(F.col("c_name")).alias("email"),
        F.when(k % 4 == 0, F.concat(F.lit("010"), F.lpad(s, 8, "0"))).when(k % 4 == 1, F.concat(F.lit("+2011"), F.lpad(s, 8, "0")))
        .when(k % 4 == 2, F.concat(F.lit("002012"), F.lpad(s, 8, "0"))).otherwise(F.concat(F.lit("n/a"), s)).alias("phone"),
        F.concat(F.lit("10.0."), (k % 256).cast("string"), F.lit("."), (k % 200).cast("string")).alias("host"),
        F.lpad((k * 7919).cast("string"), 15, "35").alias("device"), F.lpad((k * 104729 + 4539578763621486).cast("string"), 16, "4").alias("card"))


@query("c01_pattern_catalog", f"""
  SELECT entity_type, count(*) AS patterns FROM (VALUES {', '.join(f"('{p[0]}', '{p[1]}')" for p in V.PATTERNS if p[0] not in V.INACTIVE)}) v(name, entity_type)
  SEMI JOIN (SELECT unnest(list_value('PHONE_NUMBER', 'IMEI', 'CREDIT_CARD')) AS entity_type) USING (entity_type)
  WHERE (SELECT count(*) FROM customer) > 0 GROUP BY 1""")
def _q(t):
    kinds = t.customer.select(F.explode(F.array(*[F.lit(e) for e in ("PHONE_NUMBER", "IMEI", "CREDIT_CARD")])).alias("entity_type")).distinct()
    return P.catalog_rows(t.spark).join(kinds, "entity_type", "left_semi").groupBy("entity_type").agg(F.count(F.lit(1)).alias("patterns"))


def _structured_sql(column: str) -> str:
    out = []
    for p in P.catalog():
        if p["group"] != "structured" or p["script"] == "arabic" or p["validator"]:
            continue
        rx = p["regex"].replace("'", "''")
        hit = f"regexp_matches({column}, '{rx}')"
        if p["entity_type"] == "PHONE_NUMBER" and column == "phone":
            canon = "regexp_extract(regexp_replace(phone, '[^0-9]', '', 'g'), '(1[0125][0-9]{8})$', 1)"
            hit = f"({hit} OR ({canon} <> '' AND (regexp_matches('+20' || {canon}, '{rx}') OR regexp_matches('0' || {canon}, '{rx}'))))"
        out.append(f"SELECT '{column}' AS \"column\", '{p['pattern_name']}' AS pattern_name, count(*) FILTER (WHERE {hit}) AS matches, "
                   f"count({column}) AS total FROM {CONTACTS_SQL}")
    return "SELECT * FROM (" + " UNION ALL ".join(out) + ") WHERE matches > 0"


@query("c02_regex_rates_columns", f"""
  SELECT * FROM ({_structured_sql('email')}) UNION ALL SELECT * FROM ({_structured_sql('phone')}) UNION ALL SELECT * FROM ({_structured_sql('host')})""")
def _q(t):
    return P.regex_rates(contacts(t), ["email", "phone", "host"]).where("validator is null") \
        .select("column", "pattern_name", "matches", "total")


def _text_sql() -> str:
    out = []
    for p in P.catalog():
        if p["group"] != "free_text" or p["script"] == "both" or p["validator"] or p["pattern_name"] == "puk_with_label":
            continue
        rx = p["regex"].replace(r"\b", "").replace("'", "''")
        flag = "(?i)" if rx.startswith("(?i)") else ""
        rx = flag + r"(?:^|[^\pL\pN_])(?:" + rx.removeprefix("(?i)") + r")(?:$|[^\pL\pN_])"
        out.append(f"SELECT '{p['pattern_name']}' AS pattern_name, count(*) FILTER (WHERE regexp_matches(text, '{rx}')) AS matches FROM documents")
    return "SELECT * FROM (" + " UNION ALL ".join(out) + ") WHERE matches > 0"


@query("c02_regex_rates_text", _text_sql())
def _q(t):
    skip = [p["pattern_name"] for p in P.catalog() if p["script"] == "both"] + ["puk_with_label"]
    return P.regex_rates(t.documents, ["text"]).where("validator is null").where(~F.col("pattern_name").isin(skip)) \
        .select("pattern_name", "matches")


@query("c03_phone_candidates", f"""
  SELECT count(*) FILTER (WHERE k % 4 < 3) AS matches, count(*) AS total FROM {CONTACTS_SQL}""")
def _q(t):
    return P.regex_rates(contacts(t), ["phone"]).where("pattern_name = 'msisdn_egypt_international'").select("matches", "total")


@query("c04_validated_matches", f"""
  SELECT 'card' AS "column", 'credit_card_visa' AS pattern_name, count(*) FILTER (WHERE regexp_matches(card, '^4[0-9]{{12}}(?:[0-9]{{3}})?(?:[0-9]{{3}})?$')) AS regex_matches,
         count(*) FILTER (WHERE regexp_matches(card, '^4[0-9]{{12}}(?:[0-9]{{3}})?(?:[0-9]{{3}})?$') AND {luhn_sql('card')}) AS matches, 0.95::DOUBLE AS score FROM {CONTACTS_SQL}""")
def _q(t):
    return P.regex_rates(contacts(t), ["card"]).where("pattern_name = 'credit_card_visa'") \
        .select("column", "pattern_name", "regex_matches", "matches", "score")


# hits derived from parts: a column name, a pattern and a score per part
HIT_NAMES = ["score", "imei_code", "order_ts", "card_payment", "national_id", "wallet_cash", "msisdn", "notes"]
HIT_PATTERNS = ["gps_latitude", "imei", "imsi_generic", "credit_card_visa", "national_id_egypt", "vodafone_cash_account",
                "msisdn_egypt_vodafone", "imeisv", "email_address", "tax_id_egypt_plain"]


def _hits(t):
    k = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(x) for x in HIT_NAMES]), (k % len(HIT_NAMES) + 1).cast("int"))
    h = t.part.select(
        F.concat(F.lit("t"), F.floor(k / 40).cast("string")).alias("table_name"), name.alias("column"),
        F.element_at(F.array(*[F.lit(x) for x in HIT_PATTERNS]), (F.floor(k / 8) % len(HIT_PATTERNS) + 1).cast("int")).alias("pattern_name"),
        ((k * 37 % 101) / 200).alias("score"), ((k * 53 % 101) / 101).alias("match_rate"), k.alias("k"))
    cat = P.catalog_rows(t.spark).select("pattern_name", "entity_type", "collision_group", "validator")
    return h.join(F.broadcast(cat), "pattern_name")      # the catalogue has about a hundred rows


def _values(rows):
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in rows)


HITS_SQL = f"""
  (SELECT 't' || (p_partkey // 40) AS table_name, list_extract({HIT_NAMES}, p_partkey % {len(HIT_NAMES)} + 1) AS "column",
          list_extract({HIT_PATTERNS}, (p_partkey // 8) % {len(HIT_PATTERNS)} + 1) AS pattern_name, p_partkey AS k,
          (p_partkey * 37 % 101) / 200.0 AS score, (p_partkey * 53 % 101) / 101.0 AS match_rate FROM part)"""
CAT_SQL = f"(VALUES {_values([(p[0], p[1], p[5]) for p in V.PATTERNS])}) cat(pattern_name, entity_type, collision_group)"
NEG_SQL = f"(VALUES {_values([(e, tok) for e, toks in V.NEGATIVE_TOKENS.items() for tok in toks.split()])}) neg(entity_type, token)"


@query("c05_negative_name_tokens", f"""
  SELECT table_name, "column", pattern_name FROM {HITS_SQL} h JOIN {CAT_SQL} USING (pattern_name)
  WHERE NOT EXISTS (SELECT 1 FROM {NEG_SQL} WHERE neg.entity_type = cat.entity_type AND list_contains(string_split(h."column", '_'), neg.token))
    AND collision_group IS NULL""")
def _q(t):
    return P.name_signals(_hits(t).where("collision_group is null")).select("table_name", "column", "pattern_name")


@query("c06_context_boost", f"""
  WITH h AS (SELECT h.*, entity_type, row_number() OVER (PARTITION BY table_name, "column" ORDER BY score DESC, match_rate DESC, pattern_name) AS r
             FROM {HITS_SQL} h JOIN {CAT_SQL} USING (pattern_name) WHERE pattern_name IN ('email_address', 'gps_latitude') AND "column" NOT IN ('score')),
       hints AS (SELECT * FROM (VALUES {_values(sorted({(p[1], w) for p in V.PATTERNS if p[1] in ('EMAIL_ADDRESS', 'LOCATION') for w in p[8].split()}))}) v(entity_type, hint))
  SELECT k, round(CASE WHEN r = 1 AND EXISTS (SELECT 1 FROM hints WHERE hints.entity_type = h.entity_type AND contains(h."column", hint))
                       THEN least(1.0, score + 0.4) ELSE score END, 6) AS score FROM h""")
def _q(t):
    h = _hits(t).where("pattern_name in ('email_address', 'gps_latitude') and column <> 'score'")
    return P.name_signals(h).select("k", F.round("score", 6).alias("score"))


GROUP_TOKENS = [(g, p, tok, i) for i, (g, p, toks) in enumerate(V.COLLISIONS) for tok in toks.split()]


@query("c07_collision_groups", f"""
  WITH g AS (SELECT * FROM (VALUES {', '.join(f"('{g}', '{p}', '{tok}', {i})" for g, p, tok, i in GROUP_TOKENS)}) v(collision_group, pattern_name, token, pos)),
       h AS (SELECT h.*, cat.entity_type, cat.collision_group FROM {HITS_SQL} h JOIN {CAT_SQL} USING (pattern_name)
             WHERE NOT EXISTS (SELECT 1 FROM {NEG_SQL} WHERE neg.entity_type = cat.entity_type AND list_contains(string_split(h."column", '_'), neg.token))),
       s AS (SELECT n."column", g.collision_group, g.pattern_name, min(pos) AS pos, count(*) FILTER (WHERE contains(n."column", token)) AS sc
             FROM (SELECT DISTINCT "column" FROM h) n, g GROUP BY 1, 2, 3),
       w AS (SELECT "column", collision_group, arg_max(pattern_name, (sc, -pos)) AS pick FROM s GROUP BY 1, 2 HAVING max(sc) > 0)
  SELECT k FROM h LEFT JOIN w USING ("column", collision_group)
  WHERE pick IS NULL OR pick = pattern_name OR pattern_name NOT IN (SELECT pattern_name FROM g)""")
def _q(t):
    return P.name_signals(_hits(t)).select("k")


@query("c08_fold_names", """
  SELECT o_orderkey, regexp_replace(lower(replace(replace(n, 'é', 'e'), 'É', 'e')), '[ .-]+', '_', 'g') AS folded
  FROM (SELECT o_orderkey, 'Prix Été-' || o_orderpriority AS n FROM orders)""")
def _q(t):
    return t.orders.select("o_orderkey", X.fold_name(F.concat(F.lit("Prix Été-"), F.col("o_orderpriority"))).alias("folded"))


# --- validators -------------------------------------------------------------------------------------------

def _check(name, kind, text, text_sql, ok_sql, table="orders", key="o_orderkey"):
    sql = f"SELECT k, ({ok_sql}) AS valid FROM (SELECT {key} AS k, {text_sql} AS v FROM {table})"

    @query(name, sql)
    def _q(t):
        df = getattr(t, table).select(F.col(key).alias("k"), text().alias("v"))
        return P.check(df, "v", kind, "r").select("k", F.col("r.valid").alias("valid"))


def K():
    return F.col("o_orderkey")


def KS():
    return K().cast("string")


_check("c09_luhn", "luhn", lambda: F.lpad((K() * 7919).cast("string"), 16, "4"), "lpad((o_orderkey * 7919)::VARCHAR, 16, '4')", luhn_sql("v"))


def iban_sql(v):
    moved = f"substr({v}, 5) || left({v}, 4)"
    nums = f"regexp_replace(list_aggregate(list_transform(string_split({moved}, ''), lambda c: CASE WHEN regexp_matches(c, '[A-Z]') THEN (ascii(c) - 55)::VARCHAR ELSE c END), 'string_agg', ''), '', '')"
    return f"CAST({nums} AS HUGEINT) % 97 = 1 AND length({v}) = 22"


# German accounts: 18 digits; the two check digits are right for one key in ninety-seven
_check("c10_iban", "iban", lambda: F.concat(F.lit("DE"), F.lpad((K() % 97).cast("string"), 2, "0"), F.lpad((K() * 7919).cast("string"), 18, "3")),
       "'DE' || lpad((o_orderkey % 97)::VARCHAR, 2, '0') || lpad((o_orderkey * 7919)::VARCHAR, 18, '3')", iban_sql("v"))
_check("c11_swift", "swift", lambda: F.concat(F.lit("ABCD"), F.when(K() % 3 == 0, "EG").when(K() % 3 == 1, "XX").otherwise("DE"), F.lpad((K() % 100).cast("string"), 2, "0"),
                                      F.when(K() % 2 == 0, "").otherwise("XXX")),
       "'ABCD' || CASE o_orderkey % 3 WHEN 0 THEN 'EG' WHEN 1 THEN 'XX' ELSE 'DE' END || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'XXX' END",
       "regexp_matches(v, '^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$') AND substr(v, 5, 2) IN ('EG', 'DE')")
_check("c12_ksa_id", "ksa_id", lambda: F.concat((K() % 3 + 1).cast("string"), F.lpad((K() * 7919).cast("string"), 9, "0")),
       "(o_orderkey % 3 + 1)::VARCHAR || lpad((o_orderkey * 7919)::VARCHAR, 9, '0')", f"left(v, 1) IN ('1', '2') AND length(v) = 10 AND {luhn_sql('v')}")
_check("c13_uae_id", "uae_id", lambda: F.concat(F.lit("784-"), (K() % 400 + 1800).cast("string"), F.lit("-"), F.lpad((K() * 31).cast("string"), 7, "0"), F.lit("-"), (K() % 10).cast("string")),
       "'784-' || (o_orderkey % 400 + 1800) || '-' || lpad((o_orderkey * 31)::VARCHAR, 7, '0') || '-' || (o_orderkey % 10)",
       f"CAST(substr(v, 5, 4) AS INT) BETWEEN 1900 AND 2100 AND {luhn_sql('v')}")
_check("c14_mac", "mac", lambda: F.concat_ws(":", *[F.lpad(F.lower(F.hex((K() * p) % 256)), 2, "0") for p in (1, 3, 5, 7, 11, 13)]),
       "concat_ws(':', " + ", ".join(f"lpad(lower(printf('%X', (o_orderkey * {p}) % 256)), 2, '0')" for p in (1, 3, 5, 7, 11, 13)) + ")",
       "v <> '00:00:00:00:00:00' AND v <> 'ff:ff:ff:ff:ff:ff' AND substr(v, 2, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e')")
_check("c15_eth", "eth", lambda: F.concat(F.lit("0x"), F.substring(F.sha2(KS(), 256), 1, F.when(K() % 5 == 0, 39).otherwise(40))),
       "'0x' || left(sha256(o_orderkey::VARCHAR), CASE WHEN o_orderkey % 5 = 0 THEN 39 ELSE 40 END)", "regexp_matches(v, '^0x[0-9a-fA-F]{40}$')")


@query("c16_btc", "SELECT o_orderkey % 4 AS m, o_orderkey % 2 = 0 AS valid, count(*) AS n FROM orders GROUP BY ALL")
def _q(t):
    # the address of the public genesis block, and the same with one character changed
    v = F.when(K() % 2 == 0, "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa").otherwise(F.concat(F.lit("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfN"), F.when(K() % 4 == 1, "b").otherwise("0")))
    df = t.orders.select(K().alias("k"), v.alias("v"))
    return P.check(df, "v", "btc", "r").groupBy((F.col("k") % 4).alias("m"), F.col("r.valid").alias("valid")).agg(F.count(F.lit(1)).alias("n"))


HEADER = "rtrim(replace(replace(base64(v::BLOB), '+', '-'), '/', '_'), '=')"
_check("c17_jwt", "jwt", lambda: F.concat(F.rtrim(F.translate(F.base64(F.encode(F.concat(F.lit('{"'), F.when(K() % 3 == 0, "typ").otherwise("alg"), F.lit('":"'), KS(), F.lit('"}')), "utf-8")), "+/=", "-_")),
                                  F.when(K() % 5 == 0, ".").otherwise(".e30.x")),
       "CASE WHEN o_orderkey % 3 <> 0 THEN 'alg' ELSE 'typ' END || (o_orderkey % 5)", "left(v, 3) = 'alg' AND right(v, 1) <> '0'")
_check("c18_nir", "nir", lambda: F.concat(F.lpad((K() * 104729 + 1).cast("string"), 13, "1"), F.lpad((97 - (K() % 97)).cast("string"), 2, "0")),
       "lpad((o_orderkey * 104729 + 1)::VARCHAR, 13, '1') || lpad((97 - (o_orderkey % 97))::VARCHAR, 2, '0')",
       "97 - CAST(left(v, 13) AS BIGINT) % 97 = CAST(right(v, 2) AS INT)")
_check("c19_iccid", "iccid", lambda: F.concat(F.lit("8920"), F.lpad((K() * 7919).cast("string"), F.when(K() % 4 == 0, 14).otherwise(15), F.lit("0"))),
       "'8920' || lpad((o_orderkey * 7919)::VARCHAR, CASE WHEN o_orderkey % 4 = 0 THEN 14 ELSE 15 END, '0')", f"length(v) IN (19, 20) AND {luhn_sql('v')}")


def _staged(name, kind, text, text_sql, reason_sql):
    sql = f"SELECT k, {reason_sql} AS reason FROM (SELECT o_orderkey AS k, {text_sql} AS v FROM orders)"

    @query(name, sql)
    def _q(t):
        return P.check(t.orders.select(K().alias("k"), text().alias("v")), "v", kind, "r").select("k", F.col("r.reason").alias("reason"))


RBI = ", ".join(f"'{x}'" for x in C.REPORTING_BODIES)
def IMEI():
    return F.when(K() % 11 == 0, F.concat(F.lit("IM"), KS())).otherwise(F.concat(F.when(K() % 7 == 0, "77").otherwise("35"), F.lpad((K() * 7919).cast("string"), F.when(K() % 13 == 0, 12).otherwise(13), F.lit("0"))))


IMEI_SQL = "CASE WHEN o_orderkey % 11 = 0 THEN 'IM' || o_orderkey ELSE CASE WHEN o_orderkey % 7 = 0 THEN '77' ELSE '35' END || lpad((o_orderkey * 7919)::VARCHAR, CASE WHEN o_orderkey % 13 = 0 THEN 12 ELSE 13 END, '0') END"
IMEI_REASON = f"CASE WHEN regexp_matches(v, '[A-Z]') THEN 'normalize' WHEN length(v) <> 15 THEN 'format' WHEN NOT {luhn_sql('v')} THEN 'luhn' WHEN left(v, 2) NOT IN ({RBI}) THEN 'rbi' ELSE '' END"
_staged("c20_imei", "imei", lambda: IMEI(), IMEI_SQL, IMEI_REASON)
_staged("c21_imeisv", "imeisv", lambda: F.concat((K() % 100 + 10).cast("string"), F.lpad((K() * 7919).cast("string"), 14, "0")),
        "(o_orderkey % 100 + 10)::VARCHAR || lpad((o_orderkey * 7919)::VARCHAR, 14, '0')",
        f"CASE WHEN length(v) <> 16 THEN 'format' WHEN left(v, 2) NOT IN ({RBI}) THEN 'rbi' ELSE '' END")
def IMSI():
    return F.concat((K() % 900 + 100).cast("string"), F.lpad((K() * 31).cast("string"), F.when(K() % 5 == 0, 10).otherwise(12), F.lit("0")))


IMSI_SQL = "(o_orderkey % 900 + 100)::VARCHAR || lpad((o_orderkey * 31)::VARCHAR, CASE WHEN o_orderkey % 5 = 0 THEN 10 ELSE 12 END, '0')"
MCCS = ["602", "310", "262", "234", "420", "424"]


@query("c22_imsi", f"""
  SELECT k, CASE WHEN length(v) NOT IN (14, 15) THEN 'format' WHEN left(v, 3) NOT IN ('602', '310', '262', '234', '420', '424') THEN 'mcc_known'
                 WHEN left(v, 3) = '310' AND substr(v, 4, 3) NOT IN ('000', '001') THEN 'mnc_known' ELSE '' END AS reason,
         left(v, 3) = '602' AS is_home FROM (SELECT o_orderkey AS k, {IMSI_SQL} AS v FROM orders)""")
def _q(t):
    r = C.imsi(IMSI(), known_mccs=MCCS, partners={"310": ["000", "001"]})
    return t.orders.select(K().alias("k"), r.alias("r")).select("k", "r.reason", "r.is_home")


def NID():
    return F.concat((K() % 3 + 1).cast("string"), F.lpad((K() % 100).cast("string"), 2, "0"), F.lpad((K() % 13).cast("string"), 2, "0"), F.lpad((K() % 31 + 1).cast("string"), 2, "0"),
               F.lpad((K() % 40).cast("string"), 2, "0"), F.lpad((K() * 7 % 100000).cast("string"), 5, "0"))


AS_OF = "2026-01-01"          # the queries refer to a fixed day, as their SQL does
NID_SQL = ("(o_orderkey % 3 + 1)::VARCHAR || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || lpad((o_orderkey % 13)::VARCHAR, 2, '0') || lpad((o_orderkey % 31 + 1)::VARCHAR, 2, '0')"
           " || lpad((o_orderkey % 40)::VARCHAR, 2, '0') || lpad((o_orderkey * 7 % 100000)::VARCHAR, 5, '0')")
GOVS = ", ".join(f"'{g}'" for g in C.GOVERNORATES)
WEIGHTED = " + ".join(f"CAST(substr(v, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(C.CHECK_WEIGHTS))
NID_ROWS = f"""
  (SELECT k, v, b, CASE WHEN left(v, 1) NOT IN ('2', '3') THEN 'format' WHEN b IS NULL THEN 'calendar' WHEN substr(v, 8, 2) NOT IN ({GOVS}) THEN 'governorate'
     WHEN b > DATE '{AS_OF}' OR date_diff('day', b, DATE '{AS_OF}') > 110 * 366 THEN 'plausibility' ELSE '' END AS reason,
     CAST(right(v, 1) AS INT) = CASE WHEN (11 - ({WEIGHTED}) % 11) % 11 = 10 THEN 0 ELSE (11 - ({WEIGHTED}) % 11) % 11 END AS check_ok
   FROM (SELECT k, v, TRY_CAST(CASE WHEN left(v, 1) = '2' THEN '19' ELSE '20' END || substr(v, 2, 2) || '-' || substr(v, 4, 2) || '-' || substr(v, 6, 2) AS DATE) AS b
         FROM (SELECT o_orderkey AS k, {NID_SQL} AS v FROM orders)))"""


@query("c23_egypt_nid", f"""
  SELECT k, reason, CASE WHEN reason <> 'format' THEN b END AS birth_date, CASE WHEN reason <> 'format' THEN CASE WHEN CAST(substr(v, 13, 1) AS INT) % 2 = 1 THEN 'male' ELSE 'female' END END AS gender,
         CASE WHEN reason <> 'format' THEN check_ok END AS check_digit_ok FROM {NID_ROWS.replace(f"DATE '{AS_OF}'", "CURRENT_DATE")}""")
def _q(t):
    return P.check(t.orders.select(K().alias("k"), NID().alias("v")), "v", "egypt_nid", "r") \
        .select("k", "r.reason", "r.birth_date", "r.gender", "r.check_digit_ok")


@query("c24_nid_funnel", f"""
  SELECT count(*) AS non_null, count(*) AS normalize, count(*) FILTER (WHERE reason <> 'format') AS format,
         count(*) FILTER (WHERE reason NOT IN ('format', 'calendar')) AS calendar, count(*) FILTER (WHERE reason NOT IN ('format', 'calendar', 'governorate')) AS governorate,
         count(*) FILTER (WHERE reason = '') AS plausibility, count(*) FILTER (WHERE reason = '' AND check_ok) AS checkdigit FROM {NID_ROWS}""")
def _q(t):
    return P.nid_funnel(t.orders.select(NID().alias("v")), "v", AS_OF)


@query("c25_nid_rates", f"""
  WITH f AS (SELECT * FROM {NID_ROWS} WHERE reason <> 'format'), l AS (SELECT v, lag(v) OVER (ORDER BY k) AS p FROM f)
  SELECT count(*) AS nid_checked, count(*) FILTER (WHERE reason = '') AS nid_valid, round(count(*) FILTER (WHERE reason = '')::DOUBLE / count(*), 6) AS nid_valid_rate,
         round(count(*) FILTER (WHERE reason = '' AND check_ok)::DOUBLE / count(*) FILTER (WHERE reason = ''), 6) AS nid_checkdigit_rate,
         count(DISTINCT substr(v, 8, 2)) FILTER (WHERE reason = '') AS nid_gov_distinct,
         round(quantile_cont(date_diff('day', b, DATE '{AS_OF}'), 0.05) FILTER (WHERE reason = '') / 365.25, 6) AS nid_age_p05,
         round(quantile_cont(date_diff('day', b, DATE '{AS_OF}'), 0.95) FILTER (WHERE reason = '') / 365.25, 6) AS nid_age_p95,
         round(count(DISTINCT v)::DOUBLE / count(*), 6) AS nid_unique_rate,
         (SELECT round(count(*) FILTER (WHERE p <= v)::DOUBLE / (count(*) - 1), 6) FROM l) AS nid_monotonic_rate FROM f""")
def _q(t):
    df = P.nid_rates(t.orders.select(K().alias("k"), NID().alias("v")), "v", "k", AS_OF)
    for c in df.columns:
        if "rate" in c or "age" in c:
            df = df.withColumn(c, F.round(c, 6))
    return df


@query("c26_imei_rates", f"""
  SELECT count(*) FILTER (WHERE n) AS imei_checked, count(*) FILTER (WHERE n AND r = '') AS imei_valid, round(count(*) FILTER (WHERE n AND r = '')::DOUBLE / count(*) FILTER (WHERE n), 6) AS imei_valid_rate
  FROM (SELECT length(v) = 15 AND NOT regexp_matches(v, '[A-Z]') AS n, {IMEI_REASON} AS r FROM (SELECT {IMEI_SQL} AS v FROM orders))""")
def _q(t):
    return P.imei_rates(t.orders.select(IMEI().alias("v")), "v").withColumn("imei_valid_rate", F.round("imei_valid_rate", 6))


@query("c26_imsi_rates", f"""
  SELECT count(*) AS imsi_checked, count(*) FILTER (WHERE ok) AS imsi_valid, round(count(*) FILTER (WHERE ok)::DOUBLE / count(*), 6) AS imsi_valid_rate,
         round(count(*) FILTER (WHERE ok AND left(v, 3) = '602')::DOUBLE / count(*) FILTER (WHERE ok), 6) AS imsi_home_rate
  FROM (SELECT v, regexp_matches(v, '^([2-7][0-9][0-9]|901)') AS ok FROM (SELECT {IMSI_SQL} AS v FROM orders) WHERE length(v) IN (14, 15))""")
def _q(t):
    df = P.imsi_rates(t.orders.select(IMSI().alias("v")), "v")
    return df.withColumn("imsi_valid_rate", F.round("imsi_valid_rate", 6)).withColumn("imsi_home_rate", F.round("imsi_home_rate", 6))


FORMS = ["010{8}", "+2011{8}", "002012{8}", "2015{8}", "12{8}", "'010{8}", "010{8}.0", "017{8}"]
def PHONE_RAW():
    return F.regexp_replace(F.element_at(F.array(*[F.lit(x) for x in FORMS]), (K() % 8 + 1).cast("int")), r"\{8\}", F.lpad(KS(), 8, "0"))


PHONE_SQL = f"replace(list_extract({FORMS!r}, o_orderkey % 8 + 1), '{{8}}', lpad(o_orderkey::VARCHAR, 8, '0'))".replace('"\'010{8}"', "'''010{8}'")


@query("c27_msisdn_normal_form", """
  SELECT o_orderkey AS k, CASE WHEN o_orderkey % 8 < 7 THEN '+20' || list_extract(['10', '11', '12', '15', '12', '10', '10'], o_orderkey % 8 + 1) || lpad(o_orderkey::VARCHAR, 8, '0') END AS msisdn,
         list_extract(['Vodafone', 'Etisalat (e&)', 'Orange', 'WE / Telecom Egypt', 'Orange', 'Vodafone', 'Vodafone', NULL], o_orderkey % 8 + 1) AS operator FROM orders""")
def _q(t):
    return t.orders.select(K().alias("k"), C.msisdn_egypt(PHONE_RAW()).alias("msisdn"), C.operator(PHONE_RAW()).alias("operator"))


@query("c28_msisdn_stats", """
  SELECT count(*) AS checked, count(*) FILTER (WHERE m < 7) AS normalized_valid, round(count(*) FILTER (WHERE m < 7)::DOUBLE / count(*), 6) AS msisdn_valid_rate,
         count(*) FILTER (WHERE m = 1) AS plus_20, count(*) FILTER (WHERE m = 2) AS double_zero, count(*) FILTER (WHERE m = 3) AS bare_20_12,
         count(*) FILTER (WHERE m = 4) AS bare_10, count(*) FILTER (WHERE m = 6) AS excel_float FROM (SELECT o_orderkey % 8 AS m FROM orders)""")
def _q(t):
    return P.msisdn_stats(t.orders.select(PHONE_RAW().alias("v")), "v").select(
        "checked", "normalized_valid", F.round("msisdn_valid_rate", 6).alias("msisdn_valid_rate"), "plus_20", "double_zero", "bare_20_12", "bare_10", "excel_float")


@query("c28_msisdn_prefixes", """
  SELECT p AS prefix, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM (
    SELECT list_extract(['010', '011', '012', '015', '012', '010', '010', NULL], o_orderkey % 8 + 1) AS p FROM orders) WHERE p IS NOT NULL GROUP BY 1""")
def _q(t):
    return P.msisdn_prefixes(t.orders.select(PHONE_RAW().alias("v")), "v").select("prefix", "n", F.round("share", 6).alias("share"))


@query("c28_digit_lengths", f"""
  SELECT CAST(length(regexp_replace(card, '[^0-9]', '', 'g')) AS INTEGER) AS digits, count(*) AS n FROM {CONTACTS_SQL} GROUP BY 1""")
def _q(t):
    return P.digit_lengths(contacts(t), "card")


@query("c29_phone_gate", f"""
  SELECT 'phone' AS "column", round(count(*) FILTER (WHERE k % 4 < 3)::DOUBLE / count(*), 6) AS phone_shaped_rate, true AS run_phone FROM {CONTACTS_SQL}
  UNION ALL SELECT 'email', 0.0, false UNION ALL SELECT 'host', round(avg(regexp_matches(host, '^[0-9.]+$') AND length(replace(host, '.', '')) >= 7 AND
    length(replace(host, '.', ''))::DOUBLE / length(host) >= 0.7), 6), avg((length(replace(host, '.', '')) >= 7 AND length(replace(host, '.', ''))::DOUBLE / length(host) >= 0.7)::INT) >= 0.5 FROM {CONTACTS_SQL}""".replace(
    "avg(regexp_matches(host, '^[0-9.]+$') AND length(replace(host, '.', '')) >= 7 AND\n    length(replace(host, '.', ''))::DOUBLE / length(host) >= 0.7)",
    "avg((length(replace(host, '.', '')) >= 7 AND length(replace(host, '.', ''))::DOUBLE / length(host) >= 0.7)::INT)"))
def _q(t):
    return P.phone_gate(contacts(t), ["phone", "email", "host"]).select("column", F.round("phone_shaped_rate", 6).alias("phone_shaped_rate"), "run_phone")


@query("c30_phone_rates", """
  SELECT count(*) AS total, count(*) FILTER (WHERE m < 5) AS valid, count(*) FILTER (WHERE m IN (0, 1, 4)) AS mobile, count(*) FILTER (WHERE m = 5) AS unknown_plan FROM (SELECT o_orderkey % 6 AS m FROM orders)""")
def _q(t):
    tail = F.lpad((K() % 10000000).cast("string"), 7, "1")
    v = F.when(K() % 6 == 0, F.concat(F.lit("+9665"), tail, F.lit("0"))).when(K() % 6 == 1, F.concat(F.lit("+2010"), tail, F.lit("0"))) \
        .when(K() % 6 == 2, F.concat(F.lit("+962 6 "), tail)).when(K() % 6 == 3, F.concat(F.lit("+202"), tail, F.lit("1"))) \
        .when(K() % 6 == 4, F.concat(F.lit("0100"), tail)).otherwise(F.concat(F.lit("+999"), tail))
    return P.phone_rates(t.orders.select(v.alias("v")), "v").select("total", "valid", "mobile", "unknown_plan")


@query("c31_checksum_rates", f"""
  SELECT round(count(*) FILTER (WHERE {luhn_sql('device')})::DOUBLE / count(*), 6) AS luhn_pass_rate FROM {CONTACTS_SQL}""")
def _q(t):
    return P.checksum_rates(contacts(t), "device", AS_OF).select(F.round("luhn_pass_rate", 6).alias("luhn_pass_rate"))


@query("c31_check_rates_all_columns", f"""
  SELECT 'card' AS "column", 'luhn' AS kind, count(*) AS checked, count(*) FILTER (WHERE {luhn_sql('card')}) AS valid FROM {CONTACTS_SQL}
  UNION ALL SELECT 'device', 'luhn', count(*), count(*) FILTER (WHERE {luhn_sql('device')}) FROM {CONTACTS_SQL}
  UNION ALL SELECT 'phone', 'msisdn', count(*), count(*) FILTER (WHERE k % 4 < 3) FROM {CONTACTS_SQL}""")
def _q(t):
    return P.check_rates(contacts(t), {"card": ["luhn"], "device": ["luhn"], "phone": ["msisdn"]}).select("column", "kind", "checked", "valid")


# --- geography -------------------------------------------------------------------------------------------
GEO_NAMES = ["cell_lat", "cell_lon", "latency", "home_latitude", "gps_long", "long_text"]


@query("c32_geo_partners", f"""
  WITH c AS (SELECT 't' || (p_partkey // 4) AS table_name, list_extract({GEO_NAMES}, (p_partkey * 5 + p_partkey // 4) % 6 + 1) AS "column" FROM part),
       d AS (SELECT DISTINCT * FROM c),
       la AS (SELECT table_name, "column" AS lat_column, CASE "column" WHEN 'cell_lat' THEN 'cell' ELSE 'home' END AS stem FROM d WHERE "column" IN ('cell_lat', 'home_latitude')),
       lo AS (SELECT table_name, "column" AS lon_column, CASE "column" WHEN 'cell_lon' THEN 'cell' ELSE 'gps' END AS stem FROM d WHERE "column" IN ('cell_lon', 'gps_long')),
       s AS (SELECT table_name, lat_column, lon_column FROM la JOIN lo USING (table_name, stem)),
       ra AS (SELECT table_name, min(lat_column) AS lat_column FROM la ANTI JOIN s USING (table_name, lat_column) GROUP BY 1 HAVING count(*) = 1),
       ro AS (SELECT table_name, min(lon_column) AS lon_column FROM lo ANTI JOIN s USING (table_name, lon_column) GROUP BY 1 HAVING count(*) = 1)
  SELECT * FROM s UNION ALL SELECT table_name, lat_column, lon_column FROM ra JOIN ro USING (table_name)""")
def _q(t):
    k = F.col("p_partkey")
    cols = t.part.select(F.concat(F.lit("t"), F.floor(k / 4).cast("string")).alias("table_name"),
                         F.element_at(F.array(*[F.lit(x) for x in GEO_NAMES]), ((k * 5 + F.floor(k / 4)) % 6 + 1).cast("int")).alias("column")).distinct()
    return P.geo_partners(cols).select("table_name", "lat_column", "lon_column")


GEO_SQL = "(SELECT o_orderkey, printf('%d.%05d', 20 + o_orderkey % 14, o_orderkey * 7 % 100000) AS lat, printf('%d.%05d', 22 + o_orderkey % 17, o_orderkey * 11 % 100000) AS lon FROM orders)"


def _coordinates(t):
    return t.orders.select(F.format_string("%d.%05d", (20 + K() % 14), (K() * 7 % 100000)).alias("lat"), F.format_string("%d.%05d", (22 + K() % 17), (K() * 11 % 100000)).alias("lon"))


@query("c33_geo_signals", f"""
  SELECT count(*) AS checked, 'both' AS range_signal, true AS precision_signal, round(avg((lat::DOUBLE BETWEEN 22 AND 32 AND lon::DOUBLE BETWEEN 24 AND 37)::INT), 6) AS geofence_rate,
         round(count(DISTINCT lat)::DOUBLE / count(*), 6) AS distinct_rate, max(lat::DOUBLE) AS abs_max FROM {GEO_SQL}""")
def _q(t):
    return P.geo_signals(_coordinates(t), "lat", "lon").select(
        "checked", "range_signal", "precision_signal", F.round("geofence_rate", 6).alias("geofence_rate"), F.round("distinct_rate", 6).alias("distinct_rate"), "abs_max")


@query("c34_geo_scale", """
  SELECT 6 AS digits, CASE WHEN avg((23 + o_orderkey % 8 BETWEEN 22 AND 32)::INT) >= 0.8 THEN 1000000 END AS scale FROM orders
  UNION ALL SELECT 0, NULL""")
def _q(t):
    a = t.orders.select(((23 + K() % 8) * 1000000 + K() % 1000000).alias("x"), ((25 + K() % 10) * 1000000 + K() % 1000000).alias("y"))
    plain = t.orders.select((23 + K() % 8).alias("x"), (25 + K() % 10).alias("y"))
    return P.geo_scale(a, "x", "y").select(F.lit(6).alias("digits"), "scale").unionByName(P.geo_scale(plain, "x", "y").select(F.lit(0).alias("digits"), "scale"))


def _geo_rows(t):
    return t.orders.select(
        K().alias("k"), (K() % 2 == 0).alias("name"), (K() % 3 > 0).alias("partner"), F.when(K() % 5 == 0, "none").otherwise("latitude").alias("rng"),
        (K() % 7 < 3).alias("precise"), ((K() % 11) / 10.0).alias("fence"), F.when(K() % 13 == 0, 1000000).alias("scale"))


@query("c35_geo_confidence", """
  SELECT k, CASE WHEN rng = 'none' OR NOT partner OR NOT (name OR precise OR fence >= 0.8 OR scaled) THEN 'none' ELSE rng END AS verdict,
         CASE WHEN rng = 'none' OR NOT partner OR NOT (name OR precise OR fence >= 0.8 OR scaled) THEN 0.0 ELSE
           round(least(1.0, 0.3 * name::INT + 0.3 * partner::INT + 0.25 * precise::INT + 0.15 * least(1.0, fence) + 0.1 * scaled::INT), 4) END AS confidence
  FROM (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS name, o_orderkey % 3 > 0 AS partner, CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE 'latitude' END AS rng,
               o_orderkey % 7 < 3 AS precise, (o_orderkey % 11) / 10.0 AS fence, o_orderkey % 13 = 0 AS scaled FROM orders)""")
def _q(t):
    args = [F.col(c) for c in ("name", "partner", "rng", "precise", "fence", "scale")]
    return _geo_rows(t).select("k", P.geo_verdict(*args).alias("verdict"), P.geo_confidence(*args).alias("confidence"))


# --- hits, evidence and verdicts --------------------------------------------------------------------------

@query("c36_postprocess_hits")
def _q(t):
    h = _hits(t).withColumn("valid_rate", F.lit(0.9)).withColumn("context_hit", F.col("k") % 3 == 0)
    h = h.groupBy("table_name", "column", "pattern_name", "entity_type", "validator").agg(*[F.max(c).alias(c) for c in ("k", "score", "match_rate", "valid_rate", "context_hit")])
    ev = h.groupBy("table_name", "column").agg(F.min("k").alias("k")).select(
        "table_name", "column", ((F.col("k") % 4) / 4).alias("msisdn_valid_rate"), F.when(F.col("k") % 2 == 0, "IMEI").otherwise("IMSI").alias("dominant"),
        (F.col("k") % 5 == 0).alias("has_602"), (F.col("k") % 7 == 0).alias("any_imsi"), F.when(F.col("k") % 3 == 0, "latitude").otherwise("none").alias("geo_verdict"),
        F.lit(0.8).alias("geo_confidence"), F.lit(0.9).alias("geofence_rate"), F.lit(True).alias("has_partner"), F.lit(True).alias("fence_option"),
        F.lit(None).cast("int").alias("geo_scale"))
    return P.postprocess(h, ev)


NAMES = ["phone_no", "customer_id", "email", "x_lac", "notes", "contact"]
ENTITIES = ["EMAIL_ADDRESS", "PHONE_NUMBER", "EG_NATIONAL_ID", "IMEI", "LOCATION"]
LABELS = ["PHONE_NUMBER", "PERSON", "LOCATION"]


def _evidence(t):
    def score(m, null):
        return F.when(~null, (K() * m % 101) / 100.0)

    def pick(xs, k):
        return F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    return t.orders.select(
        F.concat(F.lit("t"), (K() % 100).cast("string")).alias("table_name"), pick(NAMES, K()).alias("column"), K().alias("k"), pick(ENTITIES, K()).alias("entity_type"), pick(LABELS, K()).alias("ner_label"),
        score(37, K() % 5 == 0).alias("regex_score"), score(53, K() % 3 == 0).alias("ner_score"), score(71, K() % 2 == 0).alias("review_score"),
        score(29, K() % 4 < 2).alias("phone_score"), score(13, K() % 6 == 0).alias("nid_valid_rate"), score(17, K() % 6 == 1).alias("imei_valid_rate"),
        score(19, K() % 6 == 2).alias("geo_confidence"), (K() % 8 == 0).alias("nid_ran"))


def _sc(m, null):
    return f"CASE WHEN NOT ({null}) THEN (o_orderkey * {m} % 101) / 100.0 END"


def _evidence_sql(regex="0.80", extra=""):
    return f"""
  e AS (SELECT 't' || (o_orderkey % 100) AS table_name, list_extract({NAMES}, o_orderkey % 6 + 1) AS name, o_orderkey AS k, list_extract({ENTITIES}, o_orderkey % 5 + 1) AS entity,
          list_extract({LABELS}, o_orderkey % 3 + 1) AS label, {_sc(37, 'o_orderkey % 5 = 0')} AS rs, {_sc(53, 'o_orderkey % 3 = 0')} AS ns, {_sc(71, 'o_orderkey % 2 = 0')} AS vs,
          {_sc(29, 'o_orderkey % 4 < 2')} AS ps, {_sc(13, 'o_orderkey % 6 = 0')} AS nid, {_sc(17, 'o_orderkey % 6 = 1')} AS imei, {_sc(19, 'o_orderkey % 6 = 2')} AS geo, o_orderkey % 8 = 0 AS nid_ran FROM orders),
  f AS (SELECT *, name IN ('phone_no', 'contact') AS named, coalesce(ps >= 0.8, false) AS bp, coalesce(rs >= {regex} AND entity = 'PHONE_NUMBER', false) AS br,
          coalesce(ns >= 0.7 AND label = 'PHONE_NUMBER', false) AS bn,
          CASE entity WHEN 'EG_NATIONAL_ID' THEN coalesce(nid >= 0.85, NOT nid_ran) WHEN 'IMEI' THEN coalesce(imei >= 0.85, true) WHEN 'LOCATION' THEN coalesce(geo >= 0.75, true) ELSE true END AS gate FROM e),
  g AS (SELECT *, CASE WHEN name IN ('x_lac', 'customer_id') THEN false WHEN named THEN bp OR br OR bn ELSE bp AND bp::INT + br::INT + bn::INT >= 2 END AS pv FROM f),
  h AS (SELECT *, coalesce(rs >= {regex}, false) AND gate AND (entity <> 'PHONE_NUMBER' OR pv) AS v1, coalesce(ns >= 0.7, false) AND gate AND (label <> 'PHONE_NUMBER' OR pv) AS v2,
          coalesce(vs >= 0.82, false) AS v3 FROM g),
  d AS (SELECT *, gate AND (v1 OR v2 OR v3 OR pv) AS lenient,
          gate AND (rs IS NOT NULL OR ns IS NOT NULL OR vs IS NOT NULL OR ps IS NOT NULL) AND (rs IS NULL OR v1) AND (ns IS NULL OR v2) AND (vs IS NULL OR v3) AND (ps IS NULL OR pv) AS strict,
          gate AND ((rs IS NOT NULL AND v1)::INT + (ns IS NOT NULL AND v2)::INT + (vs IS NOT NULL AND v3)::INT + (ps IS NOT NULL AND pv)::INT >= 2
            OR ((rs IS NOT NULL AND v1)::INT + (ns IS NOT NULL AND v2)::INT + (vs IS NOT NULL AND v3)::INT + (ps IS NOT NULL AND pv)::INT >= 1
                AND coalesce(greatest(rs, ns, vs, ps) >= 0.9, false))) AS balanced FROM h)"""


for _mode in ("lenient", "strict", "balanced"):
    def _make(mode):
        @query(f"c38_verdict_{mode}", f"""
          WITH {_evidence_sql()} SELECT k, {mode} AS detected, round(CASE WHEN {mode} THEN coalesce(greatest(rs, ns, vs, ps), 0.0) ELSE 0.0 END, 6) AS confidence FROM d""")
        def _q(t):
            return P.decide(_evidence(t), mode).select("k", "detected", F.round("confidence", 6).alias("confidence"))
    _make(_mode)


@query("c38_verdict_independent", f"WITH {_evidence_sql()} SELECT k, lenient AS detected FROM d")
def _q(t):
    return P.decide(_evidence(t), "independent").select("k", "detected")


@query("c37_resolve_entity", f"""
  WITH {_evidence_sql()} SELECT k, pv AS phone_eligible FROM g""")
def _q(t):
    ev = _evidence(t).withColumn("msisdn_valid_rate", F.col("phone_score")).withColumn("mobile_rate", F.lit(None).cast("double")) \
        .withColumn("phone_valid_rate", F.lit(None).cast("double"))
    return P.resolve_entity(ev).select("k", "phone_eligible")


@query("c39_column_report", f"""
  WITH {_evidence_sql()} SELECT k, balanced AS detected, CASE WHEN balanced THEN entity || ' by ' || coalesce(basis, 'gate') || ' (balanced)' ELSE 'not personal data (balanced)' END AS decision
  FROM (SELECT *, list_extract(list_reverse_sort(list_filter([CASE WHEN v1 THEN {{'s': rs, 'n': 'regex'}} END, CASE WHEN v2 THEN {{'s': ns, 'n': 'ner'}} END,
        CASE WHEN v3 THEN {{'s': vs, 'n': 'review'}} END, CASE WHEN pv AND ps IS NOT NULL THEN {{'s': ps, 'n': 'phone'}} END], lambda x: x IS NOT NULL)), 1).n AS basis FROM d)""")
def _q(t):
    ev = _evidence(t).withColumn("table_name", F.col("k").cast("string"))
    return P.report(P.decide(ev, "balanced")).select(F.col("table_name").cast("bigint").alias("k"), "detected", "decision")


LEVEL_SQL = "CASE WHEN e IN ('EG_NATIONAL_ID', 'CREDIT_CARD') THEN 'pii_sensitive' WHEN e = 'IP_ADDRESS' THEN 'pii_indirect' WHEN e = 'EMAIL' THEN 'pii_personal' WHEN e = 'JWT_TOKEN' THEN 'security_sensitive' ELSE 'internal' END"
ENTS = ["EG_NATIONAL_ID", "CREDIT_CARD", "IP_ADDRESS", "EMAIL", "JWT_TOKEN", "URL", "SOMETHING"]


@query("c40_sensitivity", f"SELECT k, {LEVEL_SQL} AS level FROM (SELECT o_orderkey AS k, list_extract({ENTS}, o_orderkey % 7 + 1) AS e FROM orders)")
def _q(t):
    e = F.element_at(F.array(*[F.lit(x) for x in ENTS]), (K() % 7 + 1).cast("int"))
    return t.orders.select(K().alias("k"), P.sensitivity(e).alias("level"))


@query("c40_strictest_level", f"""
  SELECT table_name, list_extract(['internal', 'pii_indirect', 'pii_personal', 'security_sensitive', 'pii_sensitive'], max(list_position(['internal', 'pii_indirect', 'pii_personal', 'security_sensitive', 'pii_sensitive'], {LEVEL_SQL}))) AS classification
  FROM (SELECT 't' || (o_custkey % 1000) AS table_name, list_extract({ENTS}, o_orderkey % 7 + 1) AS e FROM orders) GROUP BY 1""")
def _q(t):
    e = F.element_at(F.array(*[F.lit(x) for x in ENTS]), (K() % 7 + 1).cast("int"))
    return P.strictest(t.orders.select(F.concat(F.lit("t"), (F.col("o_custkey") % 1000).cast("string")).alias("table_name"), e.alias("entity_type")))


EDGE = [
    {"id": "r1", "when": {"name_matches": "_id$", "cardinality_ratio_gte": 0.9}, "then": {"set_entity": "NOT_PII", "note": "key"}},
    {"id": "r2", "when": {"entity": "IMEI", "logical_type": "integer"}, "then": {"set_entity": "DEVICE_ID", "add_tags": ["device"]}},
    {"id": "r3", "when": {"null_rate_lte": 0.2, "valid_rate_gte": 0.5}, "then": {"require_review": True, "set_classification": "pii_personal"}},
    {"id": "r4", "when": {"in_range": [0, 50]}, "then": {"forbid_entity": "LOCATION"}},
]


@query("c41_edge_rules", f"""
  WITH {_evidence_sql()}, x AS (SELECT *, (k * 11 % 100) / 100.0 AS card, (k * 17 % 100) / 100.0 AS nul, k % 9 = 0 AS pass, k % 2 = 0 AS intt FROM d),
  y AS (SELECT *, CASE WHEN name = 'customer_id' AND card >= 0.9 AND NOT pass THEN 'r1' WHEN entity = 'IMEI' AND intt AND NOT pass THEN 'r2'
                  WHEN nul <= 0.2 AND nid >= 0.5 THEN 'r3' WHEN k % 60 <= 50 THEN 'r4' END AS rule FROM x)
  SELECT k, rule AS edge_rule_id, CASE WHEN rule = 'r1' OR (rule = 'r4' AND entity = 'LOCATION') THEN NULL WHEN rule = 'r2' THEN 'DEVICE_ID' ELSE entity END AS entity_type,
         CASE WHEN rule = 'r1' OR (rule = 'r4' AND entity = 'LOCATION') THEN false WHEN rule = 'r2' THEN true ELSE balanced END AS detected,
         coalesce(rule = 'r3', false) AS require_review FROM y""")
def _q(t):
    k = F.col("k")
    ev = P.decide(_evidence(t), "balanced").withColumns({
        "cardinality_ratio": (k * 11 % 100) / 100.0, "null_rate": (k * 17 % 100) / 100.0, "luhn_checksum": F.when(k % 9 == 0, "pass").otherwise("fail"),
        "logical_type": F.when(k % 2 == 0, "integer").otherwise("string"), "valid_rate": F.col("nid_valid_rate"), "min_value": F.lit(0.0), "max_value": (k % 60).cast("double")})
    return P.edge_rules(ev, EDGE).select("k", "edge_rule_id", "entity_type", "detected", "require_review")


POLICY = {
    "forbidden": [("DataSensitivity", "Secret")],
    "cotags": {"Financial": ["Legal:Audit"], "Health": ["Regulation:Special"]},
    "jurisdiction": {"EG": ["Regulation:Local"]},
    "security_levels": ["Public", "Internal", "Confidential", "Restricted"],
    "security_derivation": {"Financial": "Confidential", "Health": "Restricted", "Plain": "Internal"},
    "retention": {"Financial": (3650, "Years10"), "Health": (1825, "Years5")},
    "golden_rules": [{"id": "one_security", "rule": "exactly_one", "domain": "DataSecurity"},
                     {"id": "no_mix", "rule": "mutually_exclusive", "tags": ["DataSensitivity:Health", "DataSensitivity:Plain"]}],
    "required_attributes": {"DataSensitivity:Financial": ["owner"]},
    "role_routing": {"Legal": ["Legal.*"], "DPO": ["DataSensitivity.Health"]},
}
TAGS = ["Financial", "Health", "Plain", "Secret"]


@query("c42_tag_policy", f"""
  WITH c AS (SELECT 't' || (o_custkey % 200) AS table_name, 'c' || (o_custkey % 3) AS "column", list_extract({TAGS}, o_orderkey % 4 + 1) AS tag, o_orderkey % 6 = 0 AS sug, o_orderkey % 2 = 1 AS owned FROM orders),
  b AS (SELECT table_name, "column", bool_or(NOT sug AND tag = 'Financial') AS fin, bool_or(NOT sug AND tag = 'Health') AS hea, bool_or(NOT sug AND tag = 'Plain') AS pla,
               bool_or(NOT sug AND tag = 'Secret') AS esc, bool_or(NOT sug AND tag = 'Financial' AND owned) AS own FROM c GROUP BY ALL)
  SELECT table_name, "column", CASE WHEN fin THEN 3650 WHEN hea THEN 1825 END AS retention_days,
         CASE WHEN esc THEN 'SecOps' WHEN fin THEN 'Legal' WHEN hea THEN 'DPO' ELSE 'Steward' END AS approval_role,
         CAST(NOT (fin OR hea OR pla) AS INT) + CAST(hea AND pla AS INT) + CAST(fin AND NOT own AS INT) AS n_violations,
         fin::INT + hea::INT + pla::INT + fin::INT + hea::INT + 1 + CAST(fin OR hea OR pla AS INT) + CAST(fin OR hea AS INT) AS n_tags FROM b""")
def _q(t):
    cand = t.orders.select(
        F.concat(F.lit("t"), (F.col("o_custkey") % 200).cast("string")).alias("table_name"), F.concat(F.lit("c"), (F.col("o_custkey") % 3).cast("string")).alias("column"),
        F.lit("DataSensitivity").alias("domain"), F.element_at(F.array(*[F.lit(x) for x in TAGS]), (K() % 4 + 1).cast("int")).alias("tag"), F.lit(0.9).alias("confidence"),
        (K() % 6 == 0).alias("suggest_only"), F.when(K() % 2 == 1, F.array(F.lit("owner"))).otherwise(F.array().cast("array<string>")).alias("attributes"), F.lit("eg").alias("jurisdiction"))
    return P.tags(cand, POLICY).select("table_name", "column", "retention_days", "approval_role",
                                       F.size("violations").alias("n_violations"), F.size("tags").alias("n_tags"))


@query("c43_replay_and_diff", f"""
  WITH {_evidence_sql()}, d2 AS (WITH {_evidence_sql('0.50')} SELECT k, lenient AS l2 FROM d)
  SELECT change, count(*) AS n FROM (
    SELECT CASE WHEN strict = l2 THEN 'same' WHEN l2 THEN 'now_detected' ELSE 'no_longer_detected' END AS change FROM d JOIN d2 USING (k)) GROUP BY 1""")
def _q(t):
    ev = _evidence(t).withColumn("table_name", F.col("k").cast("string"))
    settings = t.spark.createDataFrame([(0, "strict", 0.80), (1, "lenient", 0.50)], "setting int, mode string, t_regex double")
    out = P.replay(ev, settings)
    return P.verdict_diff(out.where("setting = 0"), out.where("setting = 1")).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("c44_tuning_report", f"""
  SELECT pattern_name, count(DISTINCT (table_name, "column")) AS columns, round(max(score), 6) AS max_score, round(avg(match_rate), 6) AS mean_match_rate
  FROM {HITS_SQL} GROUP BY 1 HAVING count(DISTINCT (table_name, "column")) >= 3""")
def _q(t):
    return P.tuning_report(_hits(t), 3).select("pattern_name", "columns", F.round("max_score", 6).alias("max_score"), F.round("mean_match_rate", 6).alias("mean_match_rate"))


@query("c45_conditions", """
  SELECT o_orderkey, (v > 100000 AND NOT o_orderstatus IN ('F')) OR (o_orderpriority LIKE '1-%' AND v IS NULL) AS outcome
  FROM (SELECT *, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS v FROM orders)""")
def _q(t):
    df = t.orders.withColumn("v", F.when(K() % 5 > 0, F.col("o_totalprice")))
    tree = {"any": [{"all": [{"field": "v", "op": "gt", "value": 100000}, {"not": {"field": "o_orderstatus", "op": "in", "value": ["F"]}}]},
                    {"all": [{"field": "o_orderpriority", "op": "starts_with", "value": "1-"}, {"field": "v", "op": "is_null"}]}]}
    return df.select("o_orderkey", condition(tree).alias("outcome"))

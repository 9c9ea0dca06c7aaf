"""The queries of this package, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm import bpe, chat, decontaminate, lang_id, line_rules, merkle, near_dup, phrases, quality_model, sharding, token_files, url_rules, wrappers
from tablewarden.llm.common import held_out

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


@query("op4_chat_rotation", rf"""
  WITH rows AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS who, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
  turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, who, body) - 1 AS nth FROM rows),
  openings AS (SELECT * FROM (SELECT *, min(CASE WHEN who <> 'system' THEN nth END) OVER (PARTITION BY conv_id) AS first FROM turns) WHERE who = 'system' AND nth < coalesce(first, nth + 1) AND nth < {chat.SEGMENT}),
  segments AS (SELECT DISTINCT conv_id, nth // {chat.SEGMENT} AS segment FROM turns),
  shown AS (
    SELECT conv_id, who, body, nth, nth // {chat.SEGMENT} AS segment, false AS extra FROM turns
    UNION ALL SELECT s.conv_id, who, body, nth, s.segment, true FROM segments s JOIN openings o ON o.conv_id IS NOT DISTINCT FROM s.conv_id WHERE s.segment > 0),
  people AS (SELECT DISTINCT conv_id, who AS perspective FROM rows WHERE who <> 'system'),
  pieces AS (
    SELECT t.*, p.perspective, who = perspective AS own,
           '<|im_start|>' || CASE WHEN who = perspective THEN 'assistant' WHEN who = 'system' THEN 'system' ELSE 'user name=' || replace(who, '<|', '< |') END || chr(10) AS head
    FROM shown t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
  placed AS (
    SELECT *, CAST(sum(length(head) + length(body) + 11) OVER (PARTITION BY conv_id, perspective, segment ORDER BY nth) - length(body) - 11 AS BIGINT) AS beginning FROM pieces)
  SELECT conv_id, perspective, segment, string_agg(head || body || '<|im_end|>' || chr(10), '' ORDER BY nth) AS text,
         string_agg(beginning || '-' || (beginning + length(body)), ',' ORDER BY nth) FILTER (WHERE own) AS mask, count(*) FILTER (WHERE NOT extra) AS n_turns, count(*) FILTER (WHERE extra) AS carried
  FROM placed GROUP BY conv_id, perspective, segment""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat(s["begin"], F.lit("-"), s["end"])), ",")
    return out.withColumn("mask", F.when(F.size("mask") > 0, spans))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_FREQ = r"[\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op7_line_rules", rf"""
  WITH docs AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
  grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
  twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
  covered AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
  raw AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS l FROM docs),
  lines AS (SELECT doc_id, host, text, l, trim(regexp_replace({_LOWER.format('l')}, '{_FREQ}', ' ', 'g')) AS norm FROM raw WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
  dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS d FROM lines GROUP BY doc_id),
  frequent AS (SELECT host, norm FROM lines GROUP BY ALL HAVING count(DISTINCT text) > {line_rules.MAX_DOCS}),
  removed AS (SELECT doc_id, sum(len(string_split(norm, ' '))) AS x FROM lines SEMI JOIN frequent USING (host, norm) GROUP BY doc_id),
  base AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_FREQ}', '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(d, 0) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(x, 0) AS BIGINT) AS removed_words
    FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN removed USING (doc_id))
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - removed_words) >= {line_rules.MIN_LEFT} * n_words AS kept FROM base""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query("op8_url_rules", """
  WITH parts AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages)
  SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM (
    SELECT *, CASE WHEN '.' || host LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                   WHEN '.' || host LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                   WHEN '.' || host LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
                   WHEN '.' || host LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), URL_RULES).drop("url")


@query("op10_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.assign(docs, 40).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"),
                                            F.lit(None).cast("int").alias("grown_shard"))


@query("op5_near_duplicates")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.resolve(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85)


@query("op2_quality_model")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.score(docs, model).select("_row.doc_id", held_out(F.col("_row.doc_id")).alias("held_out"), "score", "predicted")


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return lang_id.predict(docs, lang_id.train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe.round_trip(docs, bpe.Ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_path(spark)
    token_files.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), path, specials=True)
    return token_files.digests(spark, path)


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
_SIBLINGS = """
    SELECT l.part, l.rank, v.lvl, s.h, (l.rank >> v.lvl) & 1 AS bit FROM {leaves} l JOIN (SELECT DISTINCT part, lvl FROM {up} WHERE n > 1) v ON v.part = l.part
    LEFT JOIN {up} s ON s.part = l.part AND s.lvl = v.lvl AND s.rank = xor(l.rank >> v.lvl, 1)"""
_UP = """
    SELECT part, CAST(0 AS BIGINT) AS lvl, rank, n, h FROM {leaves} UNION ALL
    SELECT part, lvl + 1, rank // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY rank)) FROM {up} WHERE n > 1 GROUP BY part, lvl, rank // 2, n"""
_PATHS = "SELECT part, rank, list(CASE WHEN h IS NULL THEN 'N' WHEN bit = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY lvl) AS path FROM {siblings} GROUP BY part, rank"


@query("op13_merkle_manifest", f"""
  WITH RECURSIVE docs AS (
    SELECT doc_id, coalesce('=' || lang, '') AS part, {_LEAF.replace('{n}', 'n_chars')} AS h,
           CASE WHEN {_CRC32} % 7 = 0 THEN {_LEAF.replace('{n}', '(n_chars + 1)')} END AS tampered FROM documents),
  leaves AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, h) - 1 AS rank, count(*) OVER (PARTITION BY part) AS n FROM docs),
  up AS ({_UP.format(leaves='leaves', up='up')}),
  subroots AS (SELECT '' AS part, part AS own, h, row_number() OVER (ORDER BY part) - 1 AS rank, count(*) OVER () AS n FROM up WHERE n = 1),
  top AS ({_UP.format(leaves='subroots', up='top')}),
  inner_siblings AS ({_SIBLINGS.format(leaves='leaves', up='up')}),
  outer_siblings AS ({_SIBLINGS.format(leaves='subroots', up='top')}),
  inner_paths AS ({_PATHS.format(siblings='inner_siblings')}),
  outer_paths AS ({_PATHS.format(siblings='outer_siblings')}),
  found AS (
    SELECT l.doc_id, l.h AS leaf, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(l.tampered, l.h) AS started,
           list_concat(coalesce(i.path, []::VARCHAR[]), coalesce(o.path, []::VARCHAR[])) AS path
    FROM leaves l JOIN subroots s ON s.own = l.part LEFT JOIN inner_paths i ON i.part = l.part AND i.rank = l.rank LEFT JOIN outer_paths o ON o.rank = s.rank),
  folded AS (
    SELECT *, sha256(array_to_string(list_transform(path, lambda x: substr(x, 2)), '')) AS proof_sha256,
           list_reduce(list_concat([started], path), lambda a, e: sha256(CASE WHEN e[1] = 'L' THEN substr(e, 2) || a WHEN e[1] = 'R' THEN a || substr(e, 2) ELSE a END)) AS folded_root FROM found)
  SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    leaf = lambda n: merkle.digest(*[merkle.field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))])
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.manifest(docs, "lang", ["doc_id"], leaf(F.col("n_chars")), {"tampered": F.when(picked, leaf(F.col("n_chars") + 1))})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op11_collocations", rf"""
  WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
  spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
  ones AS (SELECT lang, w[i] AS w1, count(*) AS f FROM spots GROUP BY ALL),
  twos AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS f FROM spots WHERE i + 1 <= len(w) GROUP BY ALL HAVING count(*) >= {phrases.LEAST}),
  threes AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f FROM spots WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= {phrases.LEAST}),
  totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM ones GROUP BY lang),
  longer AS (SELECT lang, w1, w2, max(f) AS m FROM (SELECT lang, w1, w2, f FROM threes UNION ALL SELECT lang, w2, w3, f FROM threes) GROUP BY ALL),
  two AS (SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r FROM twos t JOIN ones x ON x.lang = t.lang AND x.w1 = t.w1 JOIN ones y ON y.lang = t.lang AND y.w1 = t.w2
          LEFT JOIN longer g ON g.lang = t.lang AND g.w1 = t.w1 AND g.w2 = t.w2 WHERE coalesce(100 * g.m < {phrases.COVERED} * t.f, true)),
  three AS (SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r FROM threes t JOIN ones x ON x.lang = t.lang AND x.w1 = t.w1
            JOIN twos y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
            UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f FROM threes t JOIN twos x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2
            JOIN ones y ON y.lang = t.lang AND y.w1 = t.w3),
  cuts AS (SELECT *, CAST(CAST(a AS HUGEINT) * a * 1000000 // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM (SELECT * FROM two UNION ALL SELECT * FROM three)),
  best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
  SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN totals USING (lang) WHERE rank <= 2000""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"), 2_000)


@query("op12_html_main_text")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrappers.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))

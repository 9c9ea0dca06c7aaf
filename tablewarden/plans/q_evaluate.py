"""Queries of scoring, similarity and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.functions.columns import unpivot
from tablewarden.operators import drift as D
from tablewarden.operators import evaluate as E
from tablewarden.operators import matching as N
from tablewarden.operators import sampling as M
from tablewarden.plans.registry import query
from tablewarden.session import written_once

TYPES = ["PHONE", "EMAIL", "NAME"]
LINES_IN_TASK = 500_000


def _lines(t):
    """One row per (order, line number), picked without depending on row order; grouped in as many tasks as the table's rows ask for."""
    tasks = max(t.spark.sparkContext.defaultParallelism, -(-t.lineitem.count() // LINES_IN_TASK))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").repartition(tasks, "l_orderkey", "l_linenumber")
    return lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("k"))


def gold(t, lines=None):
    n = F.col("l_linenumber")
    start = (n * 10 + F.col("s") % 5).cast("int")
    return (lines or _lines(t)).select(F.col("l_orderkey").alias("doc_id"), n.cast("bigint").alias("gid"), start.alias("start"), (start + 6).alias("end"),
                            F.element_at(F.array(*[F.lit(x) for x in TYPES]), (n % 3 + 1).cast("int")).alias("entity_type"),
                            F.when(n == 6, "advisory").when(n == 5, "structure_only").otherwise("strict").alias("grade"), F.concat(F.lit("v"), n.cast("string")).alias("value"))


def pred(t, lines=None):
    n, k = F.col("l_linenumber"), F.col("k")
    start = (n * 10 + F.col("s") % 5 + F.when(k % 4 == 0, 0).when(k % 4 == 1, 2).otherwise(0)).cast("int")
    return (lines or _lines(t)).where(k % 7 > 0).select(
        F.col("l_orderkey").alias("doc_id"), n.cast("bigint").alias("pid"), start.alias("start"), (start + 6 - F.when(k % 4 == 2, 2).otherwise(0)).cast("int").alias("end"),
        F.element_at(F.array(*[F.lit(x) for x in TYPES]), ((n + F.when(k % 5 == 0, 1).otherwise(0)) % 3 + 1).cast("int")).alias("entity_type"),
        (0.5 + (k % 50) / 100).alias("score"), F.concat(F.lit("v"), (n + F.when(k % 9 == 0, 1).otherwise(0)).cast("string")).alias("value"))


LINES = "(SELECT l_orderkey AS doc_id, l_linenumber AS n, min(l_suppkey) AS sp, min(l_partkey) AS k FROM lineitem GROUP BY 1, 2)"
GOLD = f"""(SELECT doc_id, n AS gid, CAST(n * 10 + sp % 5 AS INT) AS s, CAST(n * 10 + sp % 5 + 6 AS INT) AS e, list_extract({TYPES}, n % 3 + 1) AS t,
            CASE n WHEN 6 THEN 'advisory' WHEN 5 THEN 'structure_only' ELSE 'strict' END AS grade, 'v' || n AS v FROM {LINES})"""
PRED = f"""(SELECT doc_id, n AS pid, CAST(n * 10 + sp % 5 + CASE WHEN k % 4 = 1 THEN 2 ELSE 0 END AS INT) AS s,
            CAST(n * 10 + sp % 5 + CASE WHEN k % 4 = 1 THEN 2 ELSE 0 END + 6 - CASE WHEN k % 4 = 2 THEN 2 ELSE 0 END AS INT) AS e,
            list_extract({TYPES}, (n + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) % 3 + 1) AS t, 0.5 + (k % 50) / 100.0 AS score,
            'v' || (n + CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END) AS v FROM {LINES} WHERE k % 7 > 0)"""
IOU = "(least(g.e, p.e) - greatest(g.s, p.s))::DOUBLE / (greatest(g.e, p.e) - least(g.s, p.s))"
EXACT = f"SELECT g.doc_id, g.gid, p.pid FROM {GOLD} g JOIN {PRED} p ON g.doc_id = p.doc_id AND g.t = p.t AND g.s = p.s AND g.e = p.e"


@query("e01_exact_match", EXACT)
def _q(t):
    return E.match(gold(t), pred(t), "exact")


@query("e02_overlap_pairs", f"""
  SELECT g.doc_id, g.gid, p.pid, round({IOU}, 6) AS iou FROM {GOLD} g JOIN {PRED} p ON g.doc_id = p.doc_id AND g.t = p.t AND g.s < p.e AND p.s < g.e""")
def _q(t):
    return E.overlap_pairs(gold(t), pred(t)).select("doc_id", "gid", "pid", F.round("iou", 6).alias("iou"))


# spans of one type stand thirty characters apart here, so each gold span has one partner and greedy has no ties
@query("e02_overlap_match", f"SELECT g.doc_id, g.gid, p.pid FROM {GOLD} g JOIN {PRED} p ON g.doc_id = p.doc_id AND g.t = p.t AND g.s < p.e AND p.s < g.e AND {IOU} >= 0.5")
def _q(t):
    return E.match(gold(t), pred(t), "overlap", 0.5)


@query("e03_value_match", f"SELECT g.doc_id, g.gid, p.pid FROM {GOLD} g JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, t, v ORDER BY (substr(v, 2)::INT = pid) DESC, pid) AS r FROM {PRED}) p "
                          "ON g.doc_id = p.doc_id AND g.t = p.t AND g.v = p.v AND p.r = 1")
def _q(t):
    lines = written_once(_lines(t), "lines")
    return E.match(gold(t, lines), pred(t, lines), "value")


@query("e04_type_accuracy", f"""
  SELECT count(*) AS paired, count(*) FILTER (WHERE g.t = p.t) AS type_match, round(count(*) FILTER (WHERE g.t = p.t)::DOUBLE / count(*), 6) AS accuracy
  FROM {GOLD} g JOIN {PRED} p ON g.doc_id = p.doc_id AND g.s < p.e AND p.s < g.e AND {IOU} >= 0.5""")
def _q(t):
    return E.type_accuracy(gold(t), pred(t)).withColumn("accuracy", F.round("accuracy", 6))


OUT = f"""
  m AS ({EXACT}), o AS (
    SELECT doc_id, t, 'tp' AS kind FROM {GOLD} g WHERE grade = 'strict' AND EXISTS (SELECT 1 FROM m WHERE m.doc_id = g.doc_id AND m.gid = g.gid)
    UNION ALL SELECT doc_id, t, 'fn' FROM {GOLD} g WHERE grade = 'strict' AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = g.doc_id AND m.gid = g.gid)
    UNION ALL SELECT doc_id, t, CASE WHEN EXISTS (SELECT 1 FROM {GOLD} a WHERE a.grade = 'advisory' AND a.doc_id = p.doc_id AND a.s < p.e AND p.s < a.e) THEN 'advisory' ELSE 'fp' END
      FROM {PRED} p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = p.doc_id AND m.pid = p.pid))"""


def _outcomes(t):
    lines = written_once(_lines(t), "lines")             # matching and outcomes read both sides
    g, p = gold(t, lines), pred(t, lines)
    return E.outcomes(g, p, E.match(g, p, "exact"))


@query("e05_graded_outcomes", f"WITH {OUT} SELECT kind, t AS entity_type, count(*) AS n FROM o GROUP BY ALL")
def _q(t):
    return _outcomes(t).groupBy("kind", "entity_type").agg(F.count(F.lit(1)).alias("n"))


RATE = """round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) WHEN fn = 0 THEN 1.0 ELSE 0.0 END, 6) AS precision,
          round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 1.0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 0.0 END END, 6) AS f1"""


@query("e06_rates", f"WITH c AS (SELECT o_orderkey AS k, o_orderkey % 4 AS tp, o_orderkey % 3 AS fp, o_orderkey % 5 AS fn FROM orders) SELECT k, {RATE} FROM c")
def _q(t):
    k = F.col("o_orderkey")
    r = E.rates(k % 4, k % 3, k % 5)
    return t.orders.select(k.alias("k"), *[c.alias(n) for n, c in r.items()])


@query("e07_grouped_rates", f"""
  WITH {OUT}, a AS (
    SELECT 'micro' AS level, '' AS key, * FROM (SELECT count(*) FILTER (WHERE kind = 'tp') AS tp, count(*) FILTER (WHERE kind = 'fp') AS fp, count(*) FILTER (WHERE kind = 'fn') AS fn FROM o)
    UNION ALL SELECT 'entity', t, count(*) FILTER (WHERE kind = 'tp'), count(*) FILTER (WHERE kind = 'fp'), count(*) FILTER (WHERE kind = 'fn') FROM o GROUP BY t
    UNION ALL SELECT 'case', doc_id::VARCHAR, count(*) FILTER (WHERE kind = 'tp'), count(*) FILTER (WHERE kind = 'fp'), count(*) FILTER (WHERE kind = 'fn') FROM o GROUP BY doc_id
    UNION ALL SELECT 'tag', 'even', count(*) FILTER (WHERE kind = 'tp'), count(*) FILTER (WHERE kind = 'fp'), count(*) FILTER (WHERE kind = 'fn') FROM o WHERE doc_id % 2 = 0)
  SELECT level, key, tp, fp, fn, {RATE} FROM a""")
def _q(t):
    tags = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("doc_id"), F.array(F.lit("even")).alias("tags"))
    return E.aggregate(_outcomes(t), tags)


def _apart(df):
    """The same spans, twenty characters per line number, so neighbours never touch; values stay with their line."""
    n = F.col(df.columns[1])
    return df.withColumn("start", F.col("start") + (n * 20).cast("int")).withColumn("end", F.col("end") + (n * 20).cast("int")) \
        .withColumn("value", F.concat(F.lit("v"), n.cast("string"), F.when(F.col("value") != F.concat(F.lit("v"), n.cast("string")), "x").otherwise("")))


@query("e08_difference_classes", f"""
  WITH j AS (SELECT g.gid, p.pid, CASE WHEN p.pid IS NULL THEN 'missed' WHEN g.s = p.s AND g.e = p.e AND g.t = p.t THEN 'exact' WHEN g.s = p.s AND g.e = p.e THEN 'type_mismatch'
       WHEN g.t <> p.t AND (g.v = p.v OR {IOU} >= 0.5) THEN 'type_mismatch' WHEN g.t <> p.t THEN 'missed' WHEN g.v = p.v AND p.s <= g.s AND p.e >= g.e THEN 'superset' WHEN g.v = p.v THEN 'equivalent'
       WHEN p.s <= g.s AND p.e >= g.e THEN 'superset' WHEN g.s <= p.s AND g.e >= p.e THEN 'subset' ELSE 'overlap_partial' END AS class
     FROM {GOLD} g LEFT JOIN {PRED} p ON g.doc_id = p.doc_id AND g.gid = p.pid)
  SELECT class, count(*) AS n FROM (SELECT class FROM j UNION ALL SELECT 'spurious' FROM j WHERE class = 'missed' AND pid IS NOT NULL) GROUP BY class""")
def _q(t):
    lines = written_once(_lines(t), "lines")
    return E.classify(_apart(gold(t, lines)), _apart(pred(t, lines))).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("e08_guard_violations", f"SELECT count(*) AS n FROM {PRED} WHERE s < 25 AND e > 20 AND t = 'NAME'")
def _q(t):
    forbid = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(20).alias("start"), F.lit(25).alias("end"), F.lit("NAME").alias("entity_type"))
    lines = written_once(_lines(t), "lines")
    return E.classify(gold(t, lines), pred(t, lines), forbid).where("class = 'guard_violation'").agg(F.count(F.lit(1)).alias("n"))


@query("e09_gates", f"""
  WITH {OUT}, a AS (SELECT t AS key, count(*) FILTER (WHERE kind = 'tp') AS tp, count(*) FILTER (WHERE kind = 'fp') AS fp, count(*) FILTER (WHERE kind = 'fn') AS fn FROM o GROUP BY t)
  SELECT key, round(f1, 6) AS value, 'below minimum' AS reason FROM (SELECT key, {RATE} FROM a) WHERE f1 < 0.99""")
def _q(t):
    rep = E.aggregate(_outcomes(t))
    rules = gold(t).select("entity_type").distinct().select(
        F.lit("entity").alias("level"), F.col("entity_type").alias("key"), F.lit("f1").alias("metric"), F.lit(0.99).alias("minimum"),
        F.lit(None).cast("double").alias("maximum"), F.lit(0.1).alias("max_drop"))
    return E.gates(rep, rules, rep).select("key", F.round("value", 6).alias("value"), "reason")


@query("e10_parity", f"""
  SELECT side, count(*) AS n FROM (
    SELECT 'left' AS side FROM (SELECT doc_id, s, e, t FROM {GOLD} EXCEPT ALL SELECT doc_id, s, e, t FROM {PRED})
    UNION ALL SELECT 'right' FROM (SELECT doc_id, s, e, t FROM {PRED} EXCEPT ALL SELECT doc_id, s, e, t FROM {GOLD})) GROUP BY side""")
def _q(t):
    return E.parity(gold(t), pred(t), ["doc_id", "start", "end", "entity_type"]).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("e11_compare_runs", f"""
  SELECT CASE WHEN a = b THEN 'same' WHEN b = 'exact' THEN 'fixed' WHEN a = 'exact' THEN 'broken' ELSE 'changed' END AS change, count(*) AS n
  FROM (SELECT CASE WHEN k % 3 = 0 THEN 'exact' ELSE 'missed' END AS a, CASE WHEN k % 4 = 0 THEN 'exact' WHEN k % 4 = 1 THEN 'subset' ELSE 'missed' END AS b FROM {LINES}) GROUP BY 1""")
def _q(t):
    k = F.col("k")
    base = _lines(t).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("gid"), "k")
    a = base.withColumn("class", F.when(k % 3 == 0, "exact").otherwise("missed"))
    b = base.withColumn("class", F.when(k % 4 == 0, "exact").when(k % 4 == 1, "subset").otherwise("missed"))
    return E.compare(a, b).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("e12_table_evaluation", """
  SELECT 'c' || o_orderkey AS "column", CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 13 = 0 THEN 'extra' ELSE 'both' END AS presence,
         CASE WHEN o_orderkey % 11 > 0 AND o_orderkey % 13 = 0 THEN 'extra' WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 AND o_orderkey % 11 > 0 THEN 'tp' WHEN o_orderkey % 2 = 0 THEN 'fn'
              WHEN o_orderkey % 3 = 0 AND o_orderkey % 11 > 0 THEN 'fp' ELSE 'tn' END AS pii FROM orders WHERE NOT (o_orderkey % 11 = 0 AND o_orderkey % 13 = 0)""")
def _q(t):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("c"), k.cast("string")).alias("column")
    tags = F.array(F.lit("a"), F.lit("b")).alias("tags")
    exp = t.orders.where(k % 13 != 0).select(name, (k % 2 == 0).alias("is_pii"), F.lit("E").alias("entity_type"), F.lit("x").alias("classification"), tags)
    act = t.orders.where(k % 11 != 0).select(name, (k % 3 == 0).alias("is_pii"), F.lit("E").alias("entity_type"), F.lit("x").alias("classification"), tags)
    return E.table(exp, act).select("column", "presence", "pii")


@query("e13_gold_dataset", """
  SELECT column_name AS "column", least(5, CASE column_name WHEN 'c_mktsegment' THEN (SELECT count(DISTINCT c_mktsegment) FROM customer) WHEN 'c_name' THEN (SELECT count(DISTINCT c_name) FROM customer) END) AS n_samples
  FROM (DESCRIBE customer) WHERE column_name IN ('c_name', 'c_mktsegment')""")
def _q(t):
    cols = t.spark.createDataFrame([("c_name", True), ("c_mktsegment", False)], "column string, is_pii boolean")      # the contract
    return E.dataset(cols, t.customer).select("column", F.size("samples").cast("bigint").alias("n_samples"))


@query("e14_locate_values", """
  SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'ambiguous' ELSE 'not found' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 5 END AS start FROM orders""")
def _q(t):
    k = F.col("o_orderkey")
    docs = t.orders.select(k.alias("doc_id"), F.when(k % 3 == 0, "tel: +20(1).").when(k % 3 == 1, "+20(1) or +20(1)").otherwise("none").alias("text"))
    want = t.orders.select(k.alias("doc_id"), F.lit("PHONE").alias("entity_type"), F.lit("+20(1)").alias("value"))
    return E.locate(docs, want).select("doc_id", "status", "start")


@query("e15_validate_corpus", """
  SELECT violation, count(*) AS n FROM (
    SELECT unnest(list_filter([CASE WHEN n IS NULL THEN 'no document' END, CASE WHEN e > n THEN 'outside text' END, CASE WHEN e <= s THEN 'empty span' END, CASE WHEN l_linenumber = 5 THEN 'unknown entity' END],
                              lambda v: v IS NOT NULL)) AS violation
    FROM (SELECT l_orderkey, l_linenumber, l_linenumber * 40 AS s, l_linenumber * 40 + CASE WHEN l_linenumber = 3 THEN 0 ELSE 9 END AS e FROM lineitem) LEFT JOIN (SELECT doc_id, length(text) AS n FROM documents) ON doc_id = l_orderkey
    UNION ALL SELECT 'duplicate id' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) GROUP BY 1""")
def _q(t):
    n = F.col("l_linenumber")
    g = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), n.alias("gid"), (n * 40).alias("start"), (n * 40 + F.when(n == 3, 0).otherwise(9)).alias("end"), F.when(n == 5, "WHAT").otherwise("PHONE").alias("entity_type"))
    return E.validate(g, t.documents, ["PHONE"]).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query("e16_patch_corpus", f"""
  SELECT doc_id, gid, CASE WHEN doc_id % 3 = 0 THEN s + 1 ELSE s END AS start, e AS end, CASE WHEN doc_id % 3 = 0 THEN 'FIXED' ELSE t END AS entity_type FROM {GOLD}""")
def _q(t):
    g = gold(t)
    act = g.where("doc_id % 3 = 0").select("doc_id", "gid", (F.col("start") + 1).alias("new_start"), F.lit(None).cast("int").alias("new_end"), F.lit("FIXED").alias("new_entity"))
    return E.patch(g, act).select("doc_id", "gid", "start", "end", "entity_type")


@query("e17_curated_view", f"""
  SELECT origin, entity_type, count(*) AS n FROM (
    SELECT CASE WHEN gid = 2 THEN 'modified' ELSE 'detected' END AS origin, CASE WHEN gid = 2 THEN 'NEW' ELSE t END AS entity_type FROM {GOLD} WHERE gid <> 1
    UNION ALL SELECT 'manual', 'HAND' FROM orders) GROUP BY ALL""")
def _q(t):
    g = gold(t)
    act = g.where("gid <= 2").select("doc_id", "start", "end", F.when(F.col("gid") == 1, "reject").otherwise("modify").alias("action"), F.lit("NEW").alias("new_entity"))
    manual = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(900).alias("start"), F.lit(905).alias("end"), F.lit("HAND").alias("entity_type"))
    return E.curate(g, act, manual).groupBy("origin", "entity_type").agg(F.count(F.lit(1)).alias("n"))


# --- similarity ------------------------------------------------------------------------------------------

def _base(t):
    return t.embeddings.select(F.col("vec_id").alias("bid"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("group"))


def _queries(t):
    return t.embeddings.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("group"))


def _knn_sql(where="true", expr="1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"):
    return f"""SELECT * FROM (SELECT a.vec_id AS qid, b.vec_id AS bid, {expr} AS d, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {expr}, b.vec_id) AS INTEGER) AS rank
               FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND {where}) WHERE rank <= 5"""


@query("n01_nearest_cosine", f"SELECT qid, bid, rank, round(d, 5) AS distance FROM ({_knn_sql()})")
def _q(t):
    return N.knn(_queries(t).drop("group"), _base(t).drop("group"), 5, exclude_self=True).select("qid", "bid", "rank", F.round("distance", 5).alias("distance"))


L2 = "sqrt(greatest(0.0, 2 - 2 * list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query("n01_nearest_l2_same_class", f"SELECT qid, bid, rank, round(d, 5) AS distance FROM ({_knn_sql('a.label = b.label', L2)})")
def _q(t):
    return N.knn(_queries(t), _base(t), 5, "l2", exclude_self=True).select("qid", "bid", "rank", F.round("distance", 5).alias("distance"))


@query("n02_score_from_distance", "SELECT o_orderkey AS k, round(greatest(0.0, least(1.0, 1 - o_totalprice / 333337.0)), 6) AS cosine, round(1 / (1 + o_totalprice / 333337.0), 6) AS l2 FROM orders")
def _q(t):
    d = F.col("o_totalprice") / 333337.0
    return t.orders.select(F.col("o_orderkey").alias("k"), F.round(N.score(d, "cosine"), 6).alias("cosine"), F.round(N.score(d, "l2"), 6).alias("l2"))


@query("n03_infer_governance", f"SELECT qid, bid, 'c' || (bid % 3) AS classification FROM ({_knn_sql()}) WHERE 1 - d >= 0.3")
def _q(t):
    golden = _base(t).drop("group").withColumn("classification", F.concat(F.lit("c"), (F.col("bid") % 3).cast("string"))).withColumn("entity_type", F.lit("X"))
    hits = N.knn(_queries(t).drop("group"), golden, 5, exclude_self=True).where("score >= 0.3")
    return hits.join(golden.select("bid", "classification"), "bid").select("qid", "bid", "classification")


@query("n04_promote_golden", """
  SELECT 't' || (p_partkey % 100) AS table_name, 'c' || p_partkey AS "column", CASE WHEN p_partkey % 3 = 0 AND p_size > 10 THEN 2 ELSE 1 END AS version FROM part
  WHERE p_partkey % 2 = 0 OR (p_partkey % 3 = 0 AND p_size > 10)""")
def _q(t):
    k = F.col("p_partkey")
    cols = [F.concat(F.lit("t"), (k % 100).cast("string")).alias("table_name"), F.concat(F.lit("c"), k.cast("string")).alias("column")]
    golden = t.part.where(k % 2 == 0).select(*cols, F.lit(1).alias("version"))
    approved = t.part.where(k % 3 == 0).select(*cols, F.lit(2).alias("version"), F.col("p_size").alias("signal"), F.lit(True).alias("approved"))
    return N.promote(approved, golden, 10)


@query("n05_memory_search", f"SELECT qid, bid, round(1 - d, 5) AS similarity FROM ({_knn_sql('a.label = b.label')}) WHERE 1 - d >= 0.2")
def _q(t):
    mem = t.embeddings.select(F.col("vec_id").alias("bid"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("logical_type"))
    q = t.embeddings.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("logical_type"))
    group = F.col("logical_type")
    hits = N.knn(q.withColumn("group", group), mem.withColumn("group", group), 5, exclude_self=True)
    return hits.withColumn("similarity", 1 - F.col("distance")).where("similarity >= 0.2").select("qid", "bid", F.round("similarity", 5).alias("similarity"))


@query("n06_memory_upsert", """
  WITH m AS (SELECT p_brand AS key, count(*) AS c FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), n AS (SELECT p_brand AS key, count(*) AS c FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
  SELECT key, coalesce(m.c, 0) + coalesce(n.c, 0) AS occurrence_count, CAST(CASE WHEN m.key IS NULL THEN 0 ELSE 1 END + coalesce(n.c, 0) AS INTEGER) AS n_decisions, m.key IS NULL AS created FROM m FULL JOIN n USING (key)""")
def _q(t):
    mem = t.part.where("p_partkey % 2 = 0").groupBy(F.col("p_brand").alias("key")).agg(F.count(F.lit(1)).alias("occurrence_count")) \
        .withColumn("embedding", F.array(F.lit(1.0))).withColumn("decisions", F.array(F.lit("old")))
    new = t.part.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("key"), F.array(F.col("p_retailprice")).alias("embedding"), F.col("p_name").alias("decision"), F.col("p_partkey").alias("seen_at"))
    return N.memory_upsert(new, mem).select("key", "occurrence_count", F.size("decisions").alias("n_decisions"), "created")


@query("n07_memory_search_batch", f"SELECT qid, count(*) AS hits FROM ({_knn_sql()}) GROUP BY qid")
def _q(t):
    mem = t.embeddings.select(F.col("vec_id").alias("bid"), F.col("embedding").alias("vector"), F.lit("x").alias("logical_type"))
    q = t.embeddings.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"), F.lit("x").alias("logical_type"))
    return N.memory_search(q, mem, 5, -1.0).groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))


@query("n08_merge_facts", """
  SELECT 'c' || p_partkey AS "column", CASE WHEN p_partkey % 2 = 0 THEN p_size WHEN p_partkey % 3 = 0 THEN p_size * 10 ELSE p_size * 100 END AS ndv,
         CASE WHEN p_partkey % 2 = 0 THEN 'catalog' WHEN p_partkey % 3 = 0 THEN 'query' ELSE 'sample' END AS ndv_source FROM part""")
def _q(t):
    k = F.col("p_partkey")
    name = F.concat(F.lit("c"), k.cast("string")).alias("column")
    cat = t.part.where(k % 2 == 0).select(name, F.col("p_size").alias("ndv"))
    push = t.part.where(k % 3 == 0).select(name, (F.col("p_size") * 10).alias("ndv"))
    sample = t.part.select(name, (F.col("p_size") * 100).alias("ndv"))
    return N.facts(cat, push, sample, ["ndv"])


# --- drift and overlays ----------------------------------------------------------------------------------

def _columns(t, changed):
    k = F.col("o_orderkey")
    return t.orders.select(
        F.concat(F.lit("t"), (k % 50).cast("string")).alias("table_name"), F.concat(F.lit("c"), k.cast("string")).alias("column"), k.alias("k"),
        F.lit("n").alias("name_normalized"), F.when((k % 6 == 0) & F.lit(changed), "string").otherwise("integer").alias("logical_type"), F.lit("int").alias("physical_type"),
        F.when((k % 10 == 0) & F.lit(changed), "LL").otherwise("DD").alias("format_signature"), F.when(k % 17 == 0, "superseded").alias("lifecycle_state"))


STATE_SQL = """(SELECT 't' || (o_orderkey % 50) AS table_name, 'c' || o_orderkey AS "column", o_orderkey AS k,
   CASE WHEN o_orderkey % 17 = 0 AND o_orderkey % 7 > 0 THEN 'superseded' WHEN o_orderkey % 7 = 0 THEN 'legacy' WHEN o_orderkey % 5 = 1 THEN 'removed' WHEN o_orderkey % 6 = 0 OR o_orderkey % 10 = 0 THEN 'stale' ELSE 'active' END AS state
   FROM orders WHERE NOT (o_orderkey % 7 = 0 AND o_orderkey % 5 = 1))"""


def _drift(t):
    return D.columns(_columns(t, False).where("k % 7 > 0"), _columns(t, True).where("k % 5 <> 1"))


@query("v01_column_drift", f"""
  SELECT "column", state, CASE state WHEN 'superseded' THEN 'superseded_by_newer_decision' WHEN 'legacy' THEN 'no_baseline_fingerprint' WHEN 'removed' THEN 'column_removed_from_schema'
    WHEN 'stale' THEN concat_ws(',', CASE WHEN k % 6 = 0 THEN 'logical_type_changed' END, CASE WHEN k % 10 = 0 THEN 'format_signature_changed' END) ELSE '' END AS reasons FROM {STATE_SQL}""")
def _q(t):
    return _drift(t).select("column", "state", F.array_join("reasons", ",").alias("reasons"))


@query("v02_effective_verdict", f"""
  SELECT "column", CASE WHEN k % 3 = 0 AND state IN ('active', 'legacy') THEN 'steward' WHEN k % 4 = 0 THEN 'supplied' ELSE 'engine' END AS source,
         CASE WHEN k % 3 = 0 AND state IN ('active', 'legacy') THEN true WHEN k % 4 = 0 THEN false ELSE k % 2 = 0 END AS detected FROM {STATE_SQL}""")
def _q(t):
    k = F.substring("column", 2, 20).cast("bigint")
    d = _drift(t)
    eng = d.select("table_name", "column", (k % 2 == 0).alias("detected"), F.lit("E").alias("entity_type"), F.lit(0.5).alias("confidence"))
    st = d.where(k % 3 == 0).select("table_name", "column", F.lit(True).alias("detected"), F.lit("S").alias("entity_type"), "authoritative")
    sup = d.where(k % 4 == 0).select("table_name", "column", F.lit(False).alias("detected"), F.lit("P").alias("entity_type"), F.lit(True).alias("fingerprint_match"))
    return D.effective(eng, st, sup).select("column", "source", "detected")


@query("v03_attach_verdicts", """
  SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'skipped_no_column' WHEN o_orderkey % 3 = 0 THEN 'skipped_locked' WHEN o_orderkey % 4 = 0 THEN 'skipped_fingerprint' ELSE 'attached' END AS status FROM orders) GROUP BY 1""")
def _q(t):
    k = F.col("o_orderkey")
    key = [F.lit("t").alias("table_name"), F.concat(F.lit("c"), k.cast("string")).alias("column")]
    v = t.orders.select(*key, F.when(k % 4 == 0, "old").when(k % 2 == 0, "now").alias("fingerprint"), F.lit(True).alias("detected"), F.lit("E").alias("entity_type"))
    c = t.orders.where(k % 5 != 0).select(*key, F.lit("now").alias("fingerprint"), (k % 3 == 0).alias("locked"))
    return D.attach(v, c).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("v04_contract_diff", """
  SELECT field, kind, count(*) AS n FROM (
    SELECT 'logical_type' AS field, CASE WHEN p_size % 2 = 0 THEN 'override' ELSE 'unchanged' END AS kind FROM part
    UNION ALL SELECT 'classification', CASE WHEN p_size % 3 = 0 THEN 'add' ELSE 'unchanged' END FROM part) GROUP BY ALL""")
def _q(t):
    s = F.col("p_size")
    key = [F.lit("t").alias("table_name"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("column_name")]
    none = F.lit(None).cast("string")
    a = t.part.select(*key, F.lit("string").alias("logical_type"), none.alias("classification"))
    b = t.part.select(*key, F.when(s % 2 == 0, "integer").otherwise("string").alias("logical_type"), F.when(s % 3 == 0, "pii").otherwise(none).alias("classification"))
    return D.contract_diff(a, b).groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("v05_span_diff", f"""
  SELECT kind, count(*) AS n FROM (
    SELECT CASE WHEN p.pid IS NULL THEN 'left_only' WHEN g.s = p.s AND g.e = p.e AND g.t = p.t THEN 'agree' WHEN g.s = p.s AND g.e = p.e THEN 'type_conflict' WHEN g.t = p.t THEN 'boundary_conflict' ELSE 'left_only' END AS kind
    FROM {GOLD} g LEFT JOIN {PRED} p ON g.doc_id = p.doc_id AND g.gid = p.pid
    UNION ALL SELECT 'right_only' FROM {GOLD} g JOIN {PRED} p ON g.doc_id = p.doc_id AND g.gid = p.pid WHERE g.t <> p.t AND NOT (g.s = p.s AND g.e = p.e)) GROUP BY kind""")
def _q(t):
    return D.span_diff(gold(t), pred(t)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("v06_run_variants", """
  SELECT 'c' || o_orderkey AS "column", o_orderkey % 2 = 0 AS strict, o_orderkey % 3 = 0 AS lenient, CASE WHEN (o_orderkey % 2 = 0) = (o_orderkey % 3 = 0) THEN 1 ELSE 2 END AS distinct_verdicts FROM orders""")
def _q(t):
    k = F.col("o_orderkey")
    rows = t.orders.select(F.lit("t").alias("table_name"), F.concat(F.lit("c"), k.cast("string")).alias("column"), F.inline(F.array(
        F.struct(F.lit("strict").alias("mode"), (k % 2 == 0).alias("detected")), F.struct(F.lit("lenient").alias("mode"), (k % 3 == 0).alias("detected")))))
    return D.variants(rows, ["strict", "lenient"]).select("column", "strict", "lenient", "distinct_verdicts")


@query("v07_training_rows", """
  WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'human_decision' WHEN o_orderkey % 3 = 0 THEN 'review' END AS source, o_orderkey % 4 = 0 AS pii,
                    CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 8 = 0 END AS eng FROM orders)
  SELECT count(*) AS rows, count(*) FILTER (WHERE pii) AS pii, count(*) FILTER (WHERE eng <> pii) AS corrected, count(*) FILTER (WHERE eng IS NULL) AS unknown_baseline, count(DISTINCT k % 20) AS tables FROM r WHERE source IS NOT NULL""")
def _q(t):
    k = F.col("o_orderkey")
    key = [F.concat(F.lit("t"), (k % 20).cast("string")).alias("table_name"), F.concat(F.lit("c"), k.cast("string")).alias("column")]
    dec = t.orders.where(k % 2 == 0).select(*key, F.when(k % 4 == 0, "pii").otherwise("not_pii").alias("status"), F.lit("E").alias("entity_type"), F.lit("me").alias("decided_by"))
    rev = t.orders.where(k % 3 == 0).select(*key, F.lit("approved").alias("status"), (k % 4 == 0).alias("is_pii"), F.lit("E").alias("entity_type"))
    tel = t.orders.where(k % 5 > 0).select(*key, F.lit(0.7).alias("confidence"), (k % 8 == 0).alias("engine_detected"))
    con = t.orders.select(*key, F.lit("string").alias("logical_type"), F.lit("pii").alias("classification"))
    return D.training_audit(D.training(dec, rev, tel, con))


@query("v08_portable_violations", """
  SELECT o_orderkey AS id, field, reason FROM orders, (VALUES ('samples', 'raw field'), ('note', 'personal value')) v(field, reason)
  WHERE (field = 'samples' AND o_orderkey % 4 = 0) OR (field = 'note' AND o_orderkey % 3 = 0)""")
def _q(t):
    k = F.col("o_orderkey")
    df = t.orders.select(k.alias("id"), F.when(k % 4 == 0, F.array(F.lit("x"))).alias("samples"), F.when(k % 3 == 0, "call 010 1234 5678 9").otherwise("clean").alias("note"),
                         F.lit("20240101000000000").alias("run_id"))
    return D.portable_violations(df, "id")


SCRUBBED = r"regexp_replace(regexp_replace(regexp_replace(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email redacted]', 'g'), '\b\+?\d[\d\s()-]{8,}\d\b', '[phone redacted]', 'g'), '\b\d{10,}\b', '[identifier redacted]', 'g')"


@query("v09_scrub_text", f"SELECT o_orderkey AS k, {SCRUBBED} AS text, false AS leaks FROM (SELECT o_orderkey, 'Owner user' || o_orderkey || '@mail.com tel 0100 123 ' || (o_orderkey + 1000) || ' id ' || (o_orderkey + 10000000000) || ' end' AS t FROM orders)")
def _q(t):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Owner user"), k.cast("string"), F.lit("@mail.com tel 0100 123 "), (k + 1000).cast("string"), F.lit(" id "), (k + 10000000000).cast("string"), F.lit(" end"))
    s = D.scrub(text)
    return t.orders.select(k.alias("k"), s.alias("text"), D.residual(s).alias("leaks"))


@query("v11_retention", "SELECT count(*) AS kept, (SELECT count(*) FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 24 MONTH) AS expired FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL 24 MONTH")
def _q(t):
    kept = D.retention(t.orders, "o_orderdate", 24, "m", "2000-01-01 00:00:00").agg(F.count(F.lit(1)).alias("kept"))
    gone = D.retention(t.orders, "o_orderdate", 24, "m", "2000-01-01 00:00:00", expired=True).agg(F.count(F.lit(1)).alias("expired"))
    return kept.crossJoin(gone)


@query("v11_read_retention", """
  SELECT 't' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE 'NA' END AS value, CASE WHEN p_partkey % 2 = 0 THEN 'd' ELSE 'NA' END AS unit, p_partkey % 2 = 0 AS is_set FROM part""")
def _q(t):
    k = F.col("p_partkey")
    sla = F.when(k % 2 == 0, F.concat(F.lit('[{"property":"retention","value":'), F.col("p_size").cast("string"), F.lit(',"unit":"d","element":"ts"}]'))).otherwise("[]")
    docs = t.part.select(F.concat(F.lit('{"name":"t'), k.cast("string"), F.lit('","slaProperties":'), sla, F.lit("}")).alias("doc"))
    return D.read_retention(docs).select("name", "value", "unit", "is_set")


@query("v12_listing", """
  SELECT name, total FROM (SELECT p_name || p_partkey AS name, count(*) OVER () AS total, p_size FROM part WHERE contains(lower(p_name), 'red') AND p_brand = 'Brand#2' ORDER BY p_size DESC, name LIMIT 10 OFFSET 5)""")
def _q(t):
    idx = t.part.select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("status"), "p_size")
    return D.listing(idx, "RED", "Brand#2", "p_size", True, 10, 5).select("name", "total")


@query("x06_schema_drift", """
  SELECT coalesce(a.c, b.c) AS "column", CASE WHEN a.c IS NULL THEN 'added' WHEN b.c IS NULL THEN 'dropped' ELSE 'kept' END AS change
  FROM (SELECT unnest(['c' || p_partkey, 'd' || p_partkey]) AS c FROM part) a FULL JOIN (SELECT unnest(['c' || p_partkey, 'e' || p_partkey]) AS c FROM part) b ON a.c = b.c""")
def _q(t):
    k = F.col("p_partkey").cast("string")
    a = t.part.select(F.explode(F.array(F.concat(F.lit("c"), k), F.concat(F.lit("d"), k))).alias("column"))
    b = t.part.select(F.explode(F.array(F.concat(F.lit("c"), k), F.concat(F.lit("e"), k))).alias("column"))
    return D.schema(a, b)


# --- sampling --------------------------------------------------------------------------------------------

@query("m01_newest_partition", "SELECT event_id, CAST(ts AS DATE) AS dt FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)")
def _q(t):
    return M.partition(t.events.withColumn("dt", F.to_date("ts")), "dt").select("event_id", "dt")


def _sample_sql(table):
    return f"SELECT true AS known, true AS once, true AS sized FROM (SELECT count(*) AS n FROM {table}) WHERE n > 0"


def _sample_facts(sample, table, key, low, high):
    """What holds for any seed: every sampled row is a row of the table, none comes twice, and their number lies between the bounds."""
    found = sample.join(table.select(*key, F.lit(True).alias("_in")), key, "left")
    return found.agg(F.coalesce(F.every(F.col("_in").isNotNull()), F.lit(True)).alias("known"), (F.count(F.lit(1)) == F.count_distinct(*key)).alias("once"), F.count(F.lit(1)).alias("n")) \
        .crossJoin(F.broadcast(table.agg(F.count(F.lit(1)).alias("rows")))).select("known", "once", ((F.col("n") >= low(F.col("rows"))) & (F.col("n") <= high(F.col("rows")))).alias("sized"))      # one row each


@query("m02_fraction", _sample_sql("orders"))
def _q(t):
    spread = lambda n: 6 * F.sqrt(n * 0.09)
    return _sample_facts(M.fraction(t.orders.select("o_orderkey"), 0.1), t.orders, ["o_orderkey"], lambda n: n * 0.1 - spread(n), lambda n: n * 0.1 + spread(n))


@query("m03_column_first", _sample_sql("customer"))
def _q(t):
    # the only column with a hint in its name is kept
    named = t.customer.select(F.col("c_name").alias("customer_email"), F.col("c_mktsegment").alias("kind"), "c_custkey")
    sample = M.column_first(named, 0.5, hints=["email"])
    assert sample.columns == ["customer_email"]
    spread = lambda n: 6 * F.sqrt(n * 0.25)
    return _sample_facts(sample, named.select("customer_email"), ["customer_email"], lambda n: n * 0.5 - spread(n), lambda n: n * 0.5 + spread(n))


@query("m04_fixed_rows", _sample_sql("orders"))
def _q(t):
    return _sample_facts(M.fixed_rows(t.orders.select("o_orderkey"), 500), t.orders, ["o_orderkey"], lambda n: F.least(n, F.lit(500)) - 6 * F.sqrt(F.lit(500.0)), lambda n: F.lit(500))


@query("m05_as_strings", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_type, p_size::VARCHAR AS p_size FROM part")
def _q(t):
    return M.as_strings(t.part.drop("p_retailprice"))


@query("m06_values_per_column", """
  SELECT * FROM (VALUES ('c_name'), ('c_mktsegment')) v("column") JOIN (SELECT 'c_name' AS "column", least(20, count(DISTINCT c_name)) AS n FROM customer
    UNION ALL SELECT 'c_mktsegment', least(20, count(DISTINCT c_mktsegment)) FROM customer) USING ("column")""")
def _q(t):
    return M.values(t.customer, 20, columns=["c_name", "c_mktsegment"]).groupBy("column").agg(F.count(F.lit(1)).alias("n"))


@query("m07_detector_sample", """
  WITH v AS (SELECT 'lang' AS "column", lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'text', text FROM documents UNION ALL SELECT 'n_chars', n_chars::VARCHAR FROM documents)
  SELECT "column", least(100, count(DISTINCT value)) AS n, true AS known, true AS ranked FROM v WHERE value IS NOT NULL GROUP BY 1""")
def _q(t):
    names = ["lang", "source", "text", "n_chars"]
    seen = unpivot(t.documents, names).where("value is not null").distinct().withColumn("_in", F.lit(True))
    sample = M.values(t.documents, 100, 42, names).join(seen, ["column", "value"], "left")
    return sample.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.every(F.col("_in").isNotNull()).alias("known"), (F.max("rank") == F.count(F.lit(1))).alias("ranked"))




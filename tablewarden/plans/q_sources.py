"""Queries of sources, sinks and streams: data of the given tables written, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.operators import mask as M
from tablewarden.operators import results as Rs
from tablewarden.operators import rules as R
from tablewarden.operators import text as X
from tablewarden.operators.detect import catalog
from tablewarden.plans.q_detect import CONTACTS_SQL, contacts
from tablewarden.plans.q_mask import MASTER
from tablewarden.plans.q_suites import EVENT_RULES, FULL, FULL_CHECKS, _daily, _sets
from tablewarden.plans.q_text import FREE, _count_sql
from tablewarden.plans.registry import query
from tablewarden.session import ensure_checkpoint_dir
from tablewarden.sources import stores as St
from tablewarden.sources import tables as S
from tablewarden.streaming import monitor as Z


def scratch(spark, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:8]}"


TEXTY = "(SELECT lpad(c_custkey::VARCHAR, 8, '0') AS code, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name, 'say \"' || c_mktsegment || '\", ok' AS note FROM customer)"


def _texty(t):
    k = F.col("c_custkey")
    return t.customer.select(F.lpad(k.cast("string"), 8, "0").alias("code"), F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("name"),
                             F.concat(F.lit('say "'), "c_mktsegment", F.lit('", ok')).alias("note"))


def _text_round_trip(name, sep):
    @query(name, f"SELECT * FROM {TEXTY}")
    def _q(t):
        path = scratch(t.spark, name)
        _texty(t).write.option("header", True).option("sep", sep).option("escape", '"').option("emptyValue", '""').csv(path)
        return S.read_text_table(t.spark, path, sep)


_text_round_trip("s01_csv_as_text", ",")
_text_round_trip("s03_tsv_as_text", "\t")


@query("s02_parquet_pruned", "SELECT o_orderkey, o_orderstatus FROM orders")
def _q(t):
    return S.read_parquet(t.spark, f"{t.dir}/orders.parquet", ["o_orderkey", "o_orderstatus"])


@query("s04_jsonl_documents", """
  SELECT 'd' || doc_id AS doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN NULL ELSE text END AS text,
         CASE WHEN doc_id % 7 = 0 THEN 'invalid json' WHEN doc_id % 5 = 0 THEN 'missing field body' END AS load_error FROM documents WHERE doc_id % 7 > 0""")
def _q(t):
    path = scratch(t.spark, "jsonl")
    k = F.col("doc_id")
    good = F.to_json(F.struct(F.concat(F.lit("d"), k.cast("string")).alias("id"), F.when(k % 5 != 0, F.col("text")).alias("body")))
    t.documents.select(F.when(k % 7 == 0, F.lit("{broken")).otherwise(good).alias("value")).write.text(path)
    return S.read_jsonl_docs(t.spark, path, "body", "id").where("load_error is null or load_error <> 'invalid json'").select("doc_id", "text", "load_error")


@query("s04_jsonl_bad_lines", "SELECT count(*) AS bad FROM documents WHERE doc_id % 7 = 0")
def _q(t):
    path = scratch(t.spark, "jsonl")
    k = F.col("doc_id")
    t.documents.select(F.when(k % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(k.alias("id"), "text"))).alias("value")).write.text(path)
    return S.read_jsonl_docs(t.spark, path, "text", "id").where("load_error = 'invalid json'").agg(F.count(F.lit(1)).alias("bad"))


@query("s05_text_directory", "SELECT lang, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang")
def _q(t):
    path = scratch(t.spark, "texts")
    one = t.documents.select("lang", "doc_id", F.to_json(F.struct("lang", "text")).alias("value"))
    one.repartition("lang", "doc_id").select("lang", "value").write.partitionBy("lang").text(path)
    files = S.read_text_dir(t.spark, path, "*.txt")
    # several documents may share a file here; a document is one JSON line of it
    line = F.explode(F.split(F.rtrim("text"), "\n")).alias("line")
    docs = files.select(line).where("line <> ''").select(F.from_json("line", "lang string, text string").alias("d"))
    return docs.groupBy(F.col("d.lang").alias("lang")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("d.text")).alias("chars"))


@query("s06_csv_documents", "SELECT doc_id::VARCHAR AS doc_id, text FROM documents")
def _q(t):
    path = scratch(t.spark, "csvdocs")
    t.documents.select("doc_id", "text").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return S.read_csv_docs(t.spark, path, "text", "doc_id", multi_line=True).select("doc_id", "text")


@query("s07_duplicate_ids", "SELECT c_nationkey AS doc_id, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def _q(t):
    return S.duplicate_ids(t.customer.select(F.col("c_nationkey").alias("doc_id")))


@query("s10_scan_folder", """
  SELECT 'nation' AS table_name, count(*) AS rows FROM nation UNION ALL SELECT 'customer', count(*) FROM customer""")
def _q(t):
    done = t.spark.createDataFrame([("orders",)], "table_name string")
    files = [f"{t.dir}/{n}.parquet" for n in ("nation", "orders", "customer", "missing")]
    out, errors = S.scan_folder(t.spark, files, lambda df, name: df.agg(F.count(F.lit(1)).alias("rows")), done)
    assert [e["table_name"] for e in errors] == ["missing"]
    return out.select("table_name", "rows")


@query("s11_conform", "SELECT o_orderkey::VARCHAR AS o_orderkey, CAST(o_totalprice AS DECIMAL(12,2))::DOUBLE AS price, NULL::VARCHAR AS note FROM orders")
def _q(t):
    schema = T.StructType([T.StructField("O_ORDERKEY", T.StringType(), False), T.StructField("PRICE", T.DecimalType(12, 2)), T.StructField("NOTE", T.StringType())])
    df = S.conform(t.orders.withColumnRenamed("o_totalprice", "price"), schema)
    return df.select(F.col("O_ORDERKEY").alias("o_orderkey"), F.col("PRICE").cast("double").alias("price"), F.col("NOTE").alias("note"))


@query("s15_write_masked", f"SELECT k, sha256(email) AS email FROM {CONTACTS_SQL}")
def _q(t):
    path = scratch(t.spark, "masked")
    S.write_masked(M.apply(contacts(t).select("k", "email"), [M.MaskRule("email", "hash")], MASTER), path)
    return t.spark.read.parquet(path)


@query("s16_write_findings", f"SELECT doc_id::VARCHAR AS doc_id, count(*) AS n FROM documents, range(500) r(i) WHERE i < {_count_sql(FREE[0]['regex'])} GROUP BY 1")
def _q(t):
    path = scratch(t.spark, "findings")
    S.write_findings(X.regex_spans(t.documents, [p for p in catalog() if p["pattern_name"] == FREE[0]["pattern_name"]]), path)
    return S.read_text_table(t.spark, path).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("s17_parquet_store", f"""
  SELECT 'dt=' || dt AS partition, CAST(3 AS BIGINT) AS results, count(*) FILTER (WHERE ok) AS passed FROM {FULL_CHECKS} GROUP BY dt""")
def _q(t):
    store = St.ParquetStore(t.spark, scratch(t.spark, "store"))
    df = _daily(t)
    store.validate(df.where("dt < '2024-01-10'"), "shop.events", ["dt"], EVENT_RULES, "d1", "2024-02-01 06:00:00")
    store.validate(df, "shop.events", ["dt"], EVENT_RULES, "d1", "2024-02-01 18:00:00")      # known partitions are skipped
    return store.table(St.RESULTS).groupBy("partition").agg(F.count(F.lit(1)).alias("results"), F.count_if("passed").alias("passed"))


@query("s17_rule_set_once", "SELECT p_type AS table_name, count(*) AS rules FROM part GROUP BY 1")
def _q(t):
    store = St.ParquetStore(t.spark, scratch(t.spark, "store"))
    rows = _sets(t).withColumns({"contract_version": F.lit(""), "odcs_rule": F.lit(""), "definition": F.lit("")})
    store.save_rule_set(rows)
    store.save_rule_set(rows)
    return store.table(St.RULE_SETS).groupBy("table_name").agg(F.count(F.lit(1)).alias("rules"))


@query("s21_write_training", "SELECT count(*) AS rows, 'c_custkey,c_name' AS columns FROM customer")
def _q(t):
    return S.write_training(t.customer.select("c_custkey", "c_name"), scratch(t.spark, "training")).select("rows", "columns")


# --- catalogue and databases ------------------------------------------------------------------------------

def _database(t) -> str:
    """A new database of the session's catalogue below the shared folder."""
    name = f"db_{uuid.uuid4().hex[:10]}"
    t.spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch(t.spark, name)}'")
    return name


@query("s08_catalog_table", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def _q(t):
    db = _database(t)
    t.customer.select("c_custkey", "c_name", "c_nationkey").write.partitionBy("c_nationkey").saveAsTable(f"{db}.customer")
    assert S.read_table(t.spark, f"{db}.customer", 7).count() == 7
    return S.read_table(t.spark, f"{db}.customer")


@query("s12_catalog_columns", """
  SELECT column_name AS "column", CAST(row_number() OVER () - 1 AS INTEGER) AS ordinal, column_name = 'o_orderstatus' AS is_partition
  FROM (SELECT column_name FROM (DESCRIBE orders) WHERE column_name <> 'o_orderstatus' UNION ALL SELECT 'o_orderstatus')""")
def _q(t):
    db = _database(t)
    t.orders.write.partitionBy("o_orderstatus").saveAsTable(f"{db}.orders")
    return S.catalog_columns(t.spark, db, "orders").select("column", "ordinal", "is_partition")


@query("s13_catalog_stats", """
  WITH c AS (SELECT c_custkey % 3 AS third, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 5 END AS few FROM customer)
  SELECT 'third' AS "column", count(DISTINCT third) AS ndv, count(*) - count(third) AS num_nulls, min(third)::VARCHAR AS min, max(third)::VARCHAR AS max, true AS fresh FROM c
  UNION ALL SELECT 'few', count(DISTINCT few), count(*) - count(few), min(few)::VARCHAR, max(few)::VARCHAR, true FROM c""")
def _q(t):
    db, k = _database(t), F.col("c_custkey")
    t.customer.select((k % 3).alias("third"), F.when(k % 5 > 0, k % 5).alias("few")).write.saveAsTable(f"{db}.customer")
    return S.catalog_stats(t.spark, f"{db}.customer", ["third", "few"], analyze=True)


DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def _derby(t, name: str, df) -> str:
    """The rows as a table of a new database in memory."""
    url = f"jdbc:derby:memory:m{uuid.uuid4().hex[:10]}"
    df.write.jdbc(f"{url};create=true", name, properties=DERBY)
    return url


def _skewed(t):
    """Keys that lie close together at the start and far apart at the end, some missing."""
    k = F.col("o_orderkey")
    return t.orders.select(F.when(k % 50 > 0, F.when(k % 10 > 0, k).otherwise(k * 1000)).alias("id"), k.alias("okey"), "o_totalprice")


@query("s09_jdbc_split", "SELECT CASE WHEN o_orderkey % 50 > 0 THEN CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey ELSE o_orderkey * 1000 END END AS id, o_orderkey AS okey, o_totalprice FROM orders")
def _q(t):
    url = _derby(t, "orders_copy", _skewed(t))
    out = S.read_jdbc_split(t.spark, url, "orders_copy", '"id"', 4, **DERBY)
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]      # four rows
    assert len(sizes) > 1, sizes
    assert S.read_jdbc(t.spark, url, "orders_copy", 5, **DERBY).count() == 5
    return out.select(*[F.col(c).alias(c.lower()) for c in out.columns])


@query("s14_jdbc_metadata", """
  SELECT c AS column_name, o AS ordinal_position, rows, num_nulls, ndv FROM (
    SELECT 'ID' AS c, 1 AS o, count(*) AS rows, count(*) FILTER (WHERE o_orderkey % 50 = 0) AS num_nulls, count(DISTINCT CASE WHEN o_orderkey % 50 > 0 THEN CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey ELSE o_orderkey * 1000 END END) AS ndv FROM orders
    UNION ALL SELECT 'OKEY', 2, count(*), 0, count(DISTINCT o_orderkey) FROM orders
    UNION ALL SELECT 'O_TOTALPRICE', 3, count(*), 0, count(DISTINCT o_totalprice) FROM orders)""")
def _q(t):
    df = _skewed(t)
    url = _derby(t, "ORDERS_COPY", df.select(*[F.col(c).alias(c.upper()) for c in df.columns]))
    # this database keeps its column list under other names than the information schema
    view = """(SELECT s.schemaname AS table_schema, t.tablename AS table_name, c.columnname AS column_name, c.columnnumber AS ordinal_position, CAST(NULL AS VARCHAR(9)) AS data_type,
               CAST(NULL AS VARCHAR(3)) AS is_nullable FROM sys.syscolumns c JOIN sys.systables t ON c.referenceid = t.tableid JOIN sys.sysschemas s ON s.schemaid = t.schemaid) AS columns_"""
    columns = S.jdbc_metadata(t.spark, url, "APP", "ORDERS_COPY", view, **DERBY)
    columns = columns.select(*[F.col(c).alias(c.lower()) for c in columns.columns])
    stats = S.jdbc_stats(t.spark, url, "ORDERS_COPY", ['"ID"', '"OKEY"', '"O_TOTALPRICE"'], **DERBY).withColumn("column_name", F.trim(F.col("column"), F.lit('"')))
    # one row per column on both sides
    return columns.join(stats, "column_name").select("column_name", F.col("ordinal_position").cast("int").alias("ordinal_position"), "rows", "num_nulls", "ndv")


STORED = f"""
  SELECT 'dt=' || dt AS partition, CAST(3 AS BIGINT) AS results, count(*) FILTER (WHERE ok) AS passed FROM {FULL_CHECKS} GROUP BY dt"""


def _stored_twice(t, store):
    df = _daily(t)
    store.validate(df.where("dt < '2024-01-10'"), "shop.events", ["dt"], EVENT_RULES, "d1", "2024-02-01 06:00:00")
    store.validate(df, "shop.events", ["dt"], EVENT_RULES, "d1", "2024-02-01 18:00:00")      # known partitions are skipped
    return store.table(St.RESULTS).groupBy("partition").agg(F.count(F.lit(1)).alias("results"), F.count_if("passed").alias("passed"))


@query("s18_table_store", STORED)
def _q(t):
    return _stored_twice(t, St.TableStore(t.spark, _database(t), "parquet"))


@query("s19_database_store", STORED)
def _q(t):
    return _stored_twice(t, St.JdbcStore(t.spark, f"jdbc:derby:memory:s{uuid.uuid4().hex[:10]};create=true", **DERBY))


# --- streams ---------------------------------------------------------------------------------------------

def _stream(t):
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)


@query("z01_windowed_monitor", f"""
  SELECT strftime(dt, '%Y-%m-%d') AS window_start, n AS rows, column_name, ok AS success, bad AS unexpected_count,
         dt + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AS closed FROM {FULL_CHECKS}""")
def _q(t):
    out = Z.monitor_to_parquet(_stream(t), t.events, "ts", EVENT_RULES, scratch(t.spark, "monitor"), scratch(t.spark, "monitor-state"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "rows", "column_name", "success", "unexpected_count", "closed")


@query("z01_sliding_monitor", """
  SELECT strftime(w, '%Y-%m-%d %H') AS window_start, count(*) AS rows FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1""")
def _q(t):
    return Z.monitor(t.events, "ts", EVENT_RULES[:1], "2 hours", "1 hour").select(F.date_format("window_start", "yyyy-MM-dd HH").alias("window_start"), "rows")


@query("z02_record_stream", f"SELECT 'dt=' || dt AS partition, n AS row_count FROM {FULL}")
def _q(t):
    store, files = St.ParquetStore(t.spark, scratch(t.spark, "stream-store")), scratch(t.spark, "stream-files")
    t.events.repartition(4, "event_id").write.parquet(files)             # every day lies in every file
    daily = lambda df: df.withColumn("dt", F.to_date("ts"))
    sdf = daily(t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(files))
    for _ in range(2):        # a second run over the same data finds every run key already stored
        Z.record(sdf, "shop.events", ["dt"], EVENT_RULES, "d1", store, scratch(t.spark, "record-state"), lambda s: daily(s.read.schema(t.events.schema).parquet(files))).awaitTermination()
    return store.table(St.RUNS).select("partition", "row_count")


@query("z02_record_increments", f"SELECT 'dt=' || dt AS partition, n AS row_count, true AS same FROM {FULL}")
def _q(t):
    store, files = St.ParquetStore(t.spark, scratch(t.spark, "increments")), scratch(t.spark, "increment-files")
    t.events.repartition(3, "event_id").write.parquet(files)             # every day lies in every file
    daily = lambda df: df.withColumn("dt", F.to_date("ts"))
    sdf = daily(t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(files))
    rules = [*EVENT_RULES, R.rule("column_values_to_be_unique", "event_id"), R.rule("column_unique_value_count_to_be_between", "event_type", max_value=3)]
    Z.record_increments(sdf, "shop.events", ["dt"], rules, "d1", store, scratch(t.spark, "increment-sums"), scratch(t.spark, "increment-state")).awaitTermination()
    whole, runs = Rs.record(daily(t.spark.read.schema(t.events.schema).parquet(files)), "shop.events", ["dt"], rules, "d1", F.lit("2024-02-01 00:00:00"))
    same = ["partition", "rule_id", "passed", "unexpected_count", "observed", "message"]
    last = Rs.latest_runs(store.table(St.RUNS)).select("partition", "run_id", "row_count", "data_fingerprint")
    kept = store.table(St.RESULTS).join(last.select("run_id"), "run_id", "left_semi").select(*same)
    odd = kept.exceptAll(whole.select(*same)).unionByName(whole.select(*same).exceptAll(kept)).select("partition").distinct().withColumn("_odd", F.lit(True))
    prints = last.join(runs.select("partition", F.col("data_fingerprint").alias("_print")), "partition").join(odd, "partition", "left")
    return prints.select("partition", "row_count", (F.col("_odd").isNull() & (F.col("data_fingerprint") == F.col("_print"))).alias("same"))


@query("z03_mask_stream", "SELECT event_id, sha256(event_type) AS event_type FROM events")
def _q(t):
    out = scratch(t.spark, "mask")
    Z.run_to_parquet(Z.mask(_stream(t).select("event_id", "event_type"), [M.MaskRule("event_type", "hash")], MASTER), out, scratch(t.spark, "mask-state"))
    return t.spark.read.parquet(out)


@query("u01_custom_rule", "SELECT 'values_to_be_even' AS expectation, count(*) FILTER (WHERE o_orderkey % 2 <> 0) AS unexpected_count FROM orders")
def _q(t):
    @R.register("values_to_be_even")
    def _even(df, r):
        c = F.col(r.column)
        return R.row_rule(c % 2 != 0, F.count(c), r.kwargs, c)
    return R.validate(t.orders, [R.rule("values_to_be_even", "o_orderkey")]).select("expectation", "unexpected_count")


@query("u02_custom_validator", "SELECT 'c_name' AS \"column\", 'ends_in_seven' AS kind, count(*) AS checked, count(*) FILTER (WHERE c_name LIKE '%7') AS valid FROM customer")
def _q(t):
    from tablewarden.functions.checks import register_validator
    from tablewarden.operators.detect import check_rates
    register_validator("ends_in_seven", lambda c: c.endswith("7"))
    return check_rates(t.customer, {"c_name": ["ends_in_seven"]}).select("column", "kind", "checked", "valid")


@query("u03_custom_expander", "SELECT o_orderkey AS doc_id, 'Customer ' || o_custkey AS surface FROM orders")
def _q(t):
    docs = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("for Customer "), F.col("o_custkey").cast("string"), F.lit(" only")).alias("text"))
    X.register_expander("customer_number", lambda text: [X._tagged(X.find_spans(text, r"Customer \d+"), "CUSTOMER", 0.6, "preprocess", "customer_number")])
    out = X.expand(docs, "customer_number").select("doc_id", "surface")
    X.EXPANDERS.pop("customer_number")
    return out


@query("u04_external_spans", "SELECT doc_id, CAST(0 AS INTEGER) AS start, CAST(least(4, length(text)) AS INTEGER) AS end FROM documents WHERE length(text) > 0")
def _q(t):
    import pandas as pd

    def first_word(batches):
        for b in batches:
            b = b[b["text"].str.len() > 0]
            yield pd.DataFrame({"doc_id": b["doc_id"], "start": 0, "end": b["text"].str.len().clip(upper=4), "entity_type": "HEAD", "score": 0.5})
    X.register_spans("first_word", first_word)
    return X.produced_spans(t.documents, "first_word").select("doc_id", "start", "end")


@query("u05_custom_store", "SELECT count(*) AS n FROM orders")
def _q(t):
    class Memory(St.Store):
        kept: dict = {}

        def table(self, name):
            return self.kept[name]

        def append(self, name, df):
            self.kept[name] = df
    St.register_store("memory", Memory)
    store = St.open_store(t.spark, "memory://x")
    store.append("orders", t.orders)
    return store.table("orders").agg(F.count(F.lit(1)).alias("n"))


@query("u06_custom_sink", "SELECT count(*) FILTER (WHERE NOT ok) AS failures FROM " + FULL_CHECKS)
def _q(t):
    out = scratch(t.spark, "sink")
    St.register_sink("failures", lambda df: df.where(~F.col("success")).write.parquet(out))
    St.publish(R.validate_by(_daily(t), ["dt"], EVENT_RULES), "failures")
    return t.spark.read.parquet(out).agg(F.count(F.lit(1)).alias("failures"))


@query("u07_custom_profile", "SELECT 'c_name' AS \"column\", count(*) FILTER (WHERE c_name LIKE '%0') AS ends_in_zero FROM customer")
def _q(t):
    from tablewarden.operators import profile as P
    P.register("ends_in_zero", lambda v: F.count_if(v.endswith("0")))
    out = P.counts(t.customer, ["c_name"]).select("column", "ends_in_zero")
    P._EXTRA.pop("ends_in_zero")
    return out

"""Reading tables and documents, schema-enforced loads, catalogue metadata, and the plain sinks."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.columns import col


# --- tables ----------------------------------------------------------------------------------------------

def read_text_table(spark: SparkSession, path: str, sep: str = ",", header: bool = True, multi_line: bool = False) -> DataFrame:
    """CSV or TSV with every column as text: leading zeros stay and an empty field is an empty text, not null.

    ``multi_line`` allows line breaks inside quotes; a file is then one task, whatever its size.
    """
    df = (spark.read.option("header", header).option("inferSchema", False).option("sep", sep).option("multiLine", multi_line)
          .option("emptyValue", "").option("nullValue", "￾").option("quote", '"').option("escape", '"').csv(path))
    return df.select(*[F.coalesce(col(c), F.lit("")).alias(c) for c in df.columns])


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[col(c) for c in columns]) if columns else df


def read_table(spark: SparkSession, name: str, rows: int | None = None) -> DataFrame:
    df = spark.table(name)
    return df.limit(rows) if rows is not None else df


# fixed values: how a database says "the first n rows"
LIMITS = {"oracle": "SELECT * FROM {t} FETCH FIRST {n} ROWS ONLY", "db2": "SELECT * FROM {t} FETCH FIRST {n} ROWS ONLY",
          "derby": "SELECT * FROM {t} FETCH FIRST {n} ROWS ONLY", "sqlserver": "SELECT TOP {n} * FROM {t}"}


def bounded_query(url: str, table: str, rows: int | None) -> str:
    if not re.fullmatch(r"[\w.$\"`\[\]]+", table):
        raise ValueError(f"not a table name: {table}")
    if rows is None:
        return f"SELECT * FROM {table}"
    return LIMITS.get(url.split(":")[1], "SELECT * FROM {t} LIMIT {n}").format(t=table, n=int(rows))


def read_jdbc(spark: SparkSession, url: str, table: str, rows: int | None = None, partition_column: str | None = None,
              bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A database table; with a numeric column and bounds the read is split over several connections."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column and bounds and rows is None:
        return reader.option("dbtable", table).option("partitionColumn", partition_column).option("lowerBound", bounds[0]) \
            .option("upperBound", bounds[1]).option("numPartitions", partitions).load()
    return reader.option("query", bounded_query(url, table, rows)).load()


def _asked(spark: SparkSession, url: str, query: str, **options: str) -> list:
    """The rows of a small aggregate that the database computes."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load().collect()


def split_predicates(spark: SparkSession, url: str, table: str, column: str, partitions: int, bins: int = 1_000, **options: str) -> list[str]:
    """Conditions on a numeric column that cut a database table into about ``partitions`` parts of like size, without a gap or an overlap.

    The database itself gives the least and greatest value and counts rows in ``bins`` equal steps between them; cuts are laid where the running
    count passes the next share, so values that lie unevenly still make even parts.  Rows without a value go with the first part.
    """
    if not re.fullmatch(r"[\w$\"`\[\]]+", column):
        raise ValueError(f"not a column name: {column}")
    bounded_query(url, table, None)                      # checks the table's name
    number = f"CAST({column} AS DOUBLE PRECISION)"
    lo, hi = _asked(spark, url, f"SELECT MIN({number}) AS lo, MAX({number}) AS hi FROM {table}", **options)[0]
    if lo is None or hi <= lo or partitions < 2:
        return ["1 = 1"]
    step = (hi - lo) / bins
    counted = _asked(spark, url, f"SELECT b, COUNT(*) AS n FROM (SELECT FLOOR(({number} - ({lo!r})) / {step!r}) AS b FROM {table} WHERE {column} IS NOT NULL) AS steps GROUP BY b", **options)
    counts = sorted((min(int(r[0]), bins - 1), int(r[1])) for r in counted)
    share, done, cuts = sum(n for _, n in counts) / partitions, 0, []
    for b, n in counts:
        if done >= share * (len(cuts) + 1):              # the rows before this step fill the next part
            cuts.append(lo + b * step)
        done += n
    if not cuts:
        return ["1 = 1"]
    inner = [f"{number} >= {a!r} AND {number} < {b!r}" for a, b in zip(cuts, cuts[1:])]
    return [f"{number} < {cuts[0]!r} OR {column} IS NULL", *inner, f"{number} >= {cuts[-1]!r}"]


def read_jdbc_split(spark: SparkSession, url: str, table: str, column: str, partitions: int = 8, **options: str) -> DataFrame:
    """A database table over several connections, one for each part of ``split_predicates``."""
    return spark.read.jdbc(url, table, predicates=split_predicates(spark, url, table, column, partitions, **options), properties=options)


def jdbc_stats(spark: SparkSession, url: str, table: str, columns: Sequence[str], **options: str) -> DataFrame:
    """Rows, nulls, different values, least and greatest value (as text) per column; the database computes one small aggregate for each column."""
    bounded_query(url, table, None)

    def one(c: str) -> DataFrame:
        asked = f"SELECT COUNT(*) AS n, COUNT({c}) AS filled, COUNT(DISTINCT {c}) AS d, MIN({c}) AS lo, MAX({c}) AS hi FROM {table}"
        row = spark.read.format("jdbc").option("url", url).option("query", asked).options(**options).load()
        return row.select(F.lit(c).alias("column"), F.col("n").cast("bigint").alias("rows"), (F.col("n") - F.col("filled")).cast("bigint").alias("num_nulls"), F.col("d").cast("bigint").alias("ndv"),
                          F.col("lo").cast("string").alias("min"), F.col("hi").cast("string").alias("max"))
    return reduce(DataFrame.unionByName, [one(c) for c in columns])


def conform(df: DataFrame, schema: T.StructType, validate_required: bool = True) -> DataFrame:
    """Match columns by name without case, cast softly, add missing ones as null, order by the schema.

    A missing required column is an error at once; a null in a required column fails the job that reads it.
    """
    have = {c.lower(): c for c in df.columns}
    missing = [f.name for f in schema.fields if not f.nullable and f.name.lower() not in have]
    if missing and validate_required:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    out = []
    for f in schema.fields:
        c = col(have[f.name.lower()]).try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)
        if not f.nullable and validate_required:
            c = F.coalesce(c, F.raise_error(F.lit(f"null in required column {f.name}")).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


# --- documents -------------------------------------------------------------------------------------------

def read_jsonl_docs(spark: SparkSession, path: str, text_field: str = "body", id_field: str = "") -> DataFrame:
    """One document per JSON line; a bad line becomes a row with ``load_error``, a missing id a digest."""
    raw = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_name").alias("f")).where(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    text = F.try_variant_get(parsed, F.lit(f"$.{text_field}"), "string")
    given = F.try_variant_get(parsed, F.lit(f"$.{id_field}"), "string") if id_field else F.lit(None).cast("string")
    error = F.when(parsed.isNull(), "invalid json").when(text.isNull(), f"missing field {text_field}")
    return placed_ids(raw.select("value", "f", given.alias("_id"), text.alias("text"), error.alias("load_error")), F.col("_id"), F.concat_ws("\0", "f", "value")).select(
        "doc_id", F.col("f").alias("source"), "text", "load_error")


def read_text_dir(spark: SparkSession, root: str, glob: str = "*.txt", recursive: bool = True) -> DataFrame:
    """One document per file, named by its path below the root."""
    df = spark.read.text(root, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=recursive)
    path = F.col("_metadata.file_path")
    below = re.escape(re.sub(r"^\w+:/*", "/", root).rstrip("/"))
    return df.select(F.regexp_replace(path, f"^.*?{below}/", "").alias("doc_id"), path.alias("source"),
                     F.col("value").alias("text"), F.lit(None).cast("string").alias("load_error"))


def placed_ids(rows: DataFrame, given: Column, content: Column) -> DataFrame:
    """``doc_id``: the given id, else ``row-`` and a digest of file and content, numbered where equal rows repeat: the same however the input is split."""
    names = rows.columns
    rows = rows.withColumns({"_given": given, "_print": F.substring(F.sha2(content, 256), 1, 24)})
    # rows of one digest are equal: they combine to one row with a count inside each task, and the count makes them many again
    same = rows.where("_given IS NULL").groupBy("_print").agg(F.count(F.lit(1)).cast("int").alias("_n"), *[F.first(col(c)).alias(c) for c in names])
    nth = same.select("*", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_nth"))
    placed = nth.select(F.concat(F.lit("row-"), "_print", F.when(F.col("_nth") > 1, F.concat(F.lit("-"), F.col("_nth").cast("string"))).otherwise("")).alias("doc_id"), *[col(c) for c in names])
    return rows.where("_given IS NOT NULL").select(F.col("_given").alias("doc_id"), *[col(c) for c in names]).unionByName(placed)


def read_csv_docs(spark: SparkSession, path: str, text_column: str, id_column: str | None = None, sep: str = ",", multi_line: bool = False) -> DataFrame:
    df = read_text_table(spark, path, sep, multi_line=multi_line)
    if text_column not in df.columns:
        raise ValueError(f"no column {text_column}")
    given = col(id_column) if id_column else F.lit(None).cast("string")
    rows = df.select(given.alias("_id"), col(text_column).alias("text"), F.concat_ws("\0", F.lit(path), *[col(c) for c in df.columns]).alias("_content"))
    return placed_ids(rows, F.col("_id"), F.col("_content")).select("doc_id", F.lit(path).alias("source"), "text", F.lit(None).cast("string").alias("load_error"))


def duplicate_ids(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique_ids(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The batch does not start when an id occurs twice."""
    twice = duplicate_ids(docs, key).limit(5).collect()      # at most five examples
    if twice:
        raise ValueError(f"duplicate document ids, e.g. {[r[key] for r in twice]}")
    return docs


# --- folders ---------------------------------------------------------------------------------------------

def scan_folder(spark: SparkSession, files: Sequence[str], job: Callable[[DataFrame, str], DataFrame], done: DataFrame | None = None,
                table_from: Callable[[str], str] | None = None) -> tuple[DataFrame, list[dict[str, str]]]:
    """One lazily built result per file, glued into one job; finished tables are skipped and errors kept aside."""
    name_of = table_from or (lambda p: re.sub(r"\.\w+$", "", p.rstrip("/").rsplit("/", 1)[-1]))
    finished = {r[0] for r in done.select("table_name").distinct().collect()} if done is not None else set()     # one row per table
    frames, errors = [], []
    for path in files:
        name = name_of(path)
        if name in finished:
            continue
        try:
            df = read_parquet(spark, path) if path.endswith(".parquet") else read_text_table(spark, path, "\t" if path.endswith((".tsv", ".txt")) else ",")
            frames.append(job(df, name).withColumn("table_name", F.lit(name)))
        except Exception as e:  # noqa: BLE001 - one bad file must not stop the folder
            errors.append({"table_name": name, "error": str(e).splitlines()[0][:200]})
    return (reduce(DataFrame.unionByName, frames) if frames else None), errors


# --- catalogue -------------------------------------------------------------------------------------------

def catalog_columns(spark: SparkSession, db: str, table: str | None = None) -> DataFrame:
    """Columns of the tables of a database (metadata only)."""
    rows = []
    for t in spark.catalog.listTables(db):
        if table is None or t.name == table:
            rows += [(db, t.name, c.name, i, c.dataType, c.nullable, c.isPartition) for i, c in enumerate(spark.catalog.listColumns(f"{db}.{t.name}"))]
    return spark.createDataFrame(rows, "database string, table_name string, column string, ordinal int, physical_type string, nullable boolean, is_partition boolean")


def catalog_stats(spark: SparkSession, table: str, columns: Sequence[str], analyze: bool = False) -> DataFrame:
    """Column statistics the catalogue holds (ndv, nulls, min, max); ``analyze`` refreshes them first in one scan."""
    if analyze:
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR COLUMNS {', '.join(columns)}")
    rows = []
    for c in columns:
        info = {r["info_name"]: r["info_value"] for r in spark.sql(f"DESCRIBE EXTENDED {table} {c}").collect()}     # a dozen rows

        def value(k: str) -> str | None:
            v = info.get(k)
            return None if v in (None, "NULL") else v
        rows.append((c, value("distinct_count"), value("num_nulls"), value("min"), value("max"), value("distinct_count") is not None))
    df = spark.createDataFrame(rows, "column string, ndv string, num_nulls string, min string, max string, fresh boolean")
    return df.withColumn("ndv", F.col("ndv").cast("bigint")).withColumn("num_nulls", F.col("num_nulls").cast("bigint"))


def jdbc_metadata(spark: SparkSession, url: str, schema: str, table: str | None = None, view: str = "information_schema.columns", **options: str) -> DataFrame:
    """Columns of database tables from its information schema, filtered in the database."""
    def safe(x: str) -> str:
        return x.replace("'", "''")
    where = f"table_schema = '{safe(schema)}'" + (f" AND table_name = '{safe(table)}'" if table else "")
    query = f"SELECT table_name, column_name, ordinal_position, data_type, is_nullable FROM {view} WHERE {where}"
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


# --- sinks -----------------------------------------------------------------------------------------------

def write_masked(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    writer = df.write.mode(mode)
    writer.parquet(path) if fmt == "parquet" else writer.option("header", True).option("emptyValue", "").csv(path)


FINDING_COLUMNS = ["doc_id", "start", "end", "entity_type", "score", "engine", "recognizer", "validator"]


def write_findings(spans: DataFrame, path: str, include_text: bool = False) -> None:
    """Findings as CSV; the matched text only when asked for."""
    names = FINDING_COLUMNS + (["surface"] if include_text else [])
    spans.select(*[col(c) for c in names]).write.option("header", True).csv(path)


def write_training(df: DataFrame, path: str) -> DataFrame:
    """Training rows as JSON lines, and their manifest row: count, columns, order-free checksum."""
    df.write.json(path)
    back = df.sparkSession.read.schema(df.schema).json(path)
    row = F.to_json(F.struct(*sorted(df.columns)))
    return back.agg(F.count(F.lit(1)).alias("rows"), F.lit(",".join(sorted(df.columns))).alias("columns"),
                    F.sha2(F.concat_ws("|", F.sum(F.xxhash64(row).cast("decimal(20,0)")).cast("string"), F.count(F.lit(1)).cast("string")), 256).alias("checksum"))



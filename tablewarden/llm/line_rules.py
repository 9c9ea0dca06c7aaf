"""Quality rules: counts inside a document, and line frequency across the documents of a host.

A line that many different documents of one host share is boilerplate: normalised lines are hashed, the distinct documents that
hold each are counted per host, lines above the limit are removed from the texts, and a document that keeps too little is rejected.
Copies of one text count as one document, so a page that was crawled often does not turn its own lines into boilerplate.
Everything is a SQL expression; only line hashes travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import WORD, ascii_lower

MAX_DOCS = 25                 # a line in more different documents of a host than this is removed
MIN_LEFT = 20                 # per cent of a document's words that must stay
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: sort the windows' hashes, take the places of equal neighbours."""
    def places(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        return F.transform(F.filter(F.sequence(F.lit(0), last), lambda j: same(j, j - 1) | same(j, j + 1)), lambda j: F.get(s, j)["i"])

    def of(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        covered = let(ordered, lambda s: F.size(F.array_distinct(F.flatten(F.transform(places(s), lambda p: F.array(p, p + 1, p + 2))))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows(w), of)))


def lines_of(text: Column) -> Column:
    """Lines that hold a word, as they are."""
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))


def normal(line: Column) -> Column:
    """A-Z lower-cased, runs of white space as one space, none at the ends."""
    lowered = F.when(F.length(line) == F.octet_length(line), F.lower(line)).otherwise(ascii_lower(line))       # translate costs far more a character
    return F.trim(F.regexp_replace(lowered, r"[\x20\x09-\x0D]+", " "))


def word_count(line: Column) -> Column:
    """Words of a normalised line."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def measures(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    both = let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeat_words(w).cast("bigint").alias("r"), F.length(F.array_join(w, "")).cast("bigint").alias("c")))
    dup = let(lines_of(t), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))
    return [both.alias("_both"), F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"), dup.cast("bigint").alias("n_dup_lines")]


def _judged(docs: DataFrame, columns: list[str], max_docs: int, min_left: int) -> DataFrame:
    """Measures and verdict of every row, with ``columns`` in the struct ``_row`` and the hashes of its frequent lines (null: none) in ``_frequent``."""
    text = F.col("text").cast("string")
    host, digest = F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("_host"), F.xxhash64(text).alias("_text")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), host, digest, *measures(text)).select(
        "_row", "_host", "_text", F.col("_both.n").alias("n_words"), F.col("_both.c").alias("word_chars"), "n_symbols", "n_dup_lines", F.col("_both.r").alias("n_repeat_words"))
    lines = F.transform(lines_of(F.coalesce(text, F.lit(""))), normal)
    counted = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), word_count(x).alias("words")))
    held = docs.select(host, digest, F.explode(counted).alias("l")).select("_host", "_text", "l.line", "l.words")
    # one row for each different text of a host and line: how often the text holds it does not matter for the count of documents
    held = held.groupBy("_host", "_text", "line").agg(F.max("words").alias("words"), F.count(F.lit(1)).alias("_times"))
    frequent = held.groupBy("_host", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > max_docs).select("_host", "line")
    removed = held.join(frequent, ["_host", "line"]).groupBy("_host", "_text").agg(
        F.sum(F.col("words") * F.col("_times")).alias("_removed"), F.collect_list("line").alias("_frequent"))  # as many hashes as the text has lines, at most
    copies = docs.select(host, digest).groupBy("_host", "_text").agg(F.count(F.lit(1)).alias("_copies"))
    removed = removed.join(copies, ["_host", "_text"]).select("_host", "_text", (F.col("_removed") / F.col("_copies")).cast("bigint").alias("removed_words"), "_frequent")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    gone = F.coalesce("removed_words", F.lit(0))
    return base.join(removed, ["_host", "_text"], "left").select(
        "_row", "_frequent", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), gone.alias("removed_words"),
        (~failed & (100 * (F.col("n_words") - gone) >= min_left * F.col("n_words"))).alias("kept"))


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: int = MIN_LEFT) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept.

    ``docs`` needs doc_id, text and source (the host).  A null text has no words and fails the base rules; rows without a source
    form one host; rows without a doc_id are judged like others.  Repeated rows are each returned.
    """
    return _judged(docs, ["doc_id"], max_docs, min_left).select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


def without(text: Column, frequent: Column) -> Column:
    """The text without the lines whose hash is in ``frequent``; all other lines, blank ones too, stay as they are.  Null ``frequent``: the text itself."""
    left = F.filter(F.split(text, "\n", -1), lambda line: ~F.array_contains(frequent, F.xxhash64(normal(line))))
    return F.when(frequent.isNull(), text).otherwise(F.array_join(left, "\n"))


def _cleaned(judged: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows in ``_row`` with all columns of ``docs``, frequent lines removed from ``text``."""
    kinds = dict(docs.dtypes)
    field = lambda c: F.col("_row").getField(c)
    return judged.select(*[(without(field(c).cast("string"), F.col("_frequent")).cast(kinds[c]) if c.lower() == "text" else field(c)).alias(c) for c in docs.columns])


def clean(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Every row of ``docs``, kept or not, with all its columns; ``text`` has lost its frequent lines, so it holds n_words - removed_words words."""
    return _cleaned(_judged(docs, docs.columns, max_docs, MIN_LEFT), docs)


def keep(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: int = MIN_LEFT) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns whatever these are called; ``text`` has lost its frequent lines."""
    return _cleaned(_judged(docs, docs.columns, max_docs, min_left).where("kept"), docs)

"""Regex matches with offsets, splices and interval joins, inside the JVM.

Spark's regex functions give matched text but no positions.  Here every match is wrapped in two non-characters by
one ``regexp_replace``, the text is split at the opening mark, and sums over the lengths of the pieces give code-point
offsets.  The sums run in blocks, so that a long text with many matches costs little more than its length.  The whole
text is scanned and nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.columns import col, let

OPEN, CLOSE = "﷐", "﷑"
SPANS = "array<struct<start:int,end:int,surface:string>>"


def find_spans(text: Column, regex: str, replacement: str | None = None) -> Column:
    """array<struct(start, end, surface)> of all matches, null when there is none.

    ``replacement`` marks a part of the match: write the regex with three groups (before, value, after) and pass
    ``parts()`` to get the offsets of the value only.
    """
    clean = F.translate(text, OPEN + CLOSE, "  ")
    marked = F.regexp_replace(clean, F.lit(regex), F.lit(replacement or f"{OPEN}$0{CLOSE}"))
    found = let(F.split(marked, OPEN, -1), lambda pieces: let(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda rest: F.zip_with(
        rest, sums_before(F.transform(rest, lambda p: F.length(p) - 1), F.length(F.get(pieces, 0))), _span)))
    return F.when(text.rlike(regex), F.filter(found, lambda s: s["end"] > s["start"]))


def _span(piece: Column, begin: Column) -> Column:
    surface = F.split_part(piece, F.lit(CLOSE), F.lit(1))
    return F.struct(begin.alias("start"), (begin + F.length(surface)).alias("end"), surface.alias("surface"))


def sums_before(numbers: Column, start: Column) -> Column:
    """For each number of an array: ``start`` and all numbers before it, added up.

    A fold that appends copies its result at every step.  So blocks of about the square root of the length are added up first, then inside each
    block an own small fold appends: n * sqrt(n) copied references in place of n * n.
    """
    def fold(array: Column, first: Column, value: Callable[[Column], Column]) -> Column:
        zero = F.struct(first.cast("int").alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(array, zero, lambda a, x: F.struct((a["sum"] + value(x)).alias("sum"), F.array_append(a["out"], a["sum"]).alias("out")), lambda a: a["out"])

    def blocked(values: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(values).cast("double"))), F.lit(1)).cast("int")

        def cut(width: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), width), lambda lo: F.slice(values, lo + 1, width))
            return let(blocks, lambda bs: F.flatten(F.zip_with(bs, fold(bs, start, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x)), lambda b, first: fold(b, first, lambda x: x))))
        return let(size, cut)
    return let(numbers, blocked)


CHUNK = 1_024


def spliced(text: Column, edits: Column) -> Column:
    """The text with sorted, disjoint edits (array of start, end, new) put in.

    The text is cut once into chunks of characters, and what stands between two edits is read from the chunks it lies in, so nothing is copied twice.
    """
    def piece(chunks: Column, a: Column, b: Column) -> Column:
        def inside(k: Column) -> Column:
            lo, hi = F.greatest(a - k * CHUNK, F.lit(0)), F.least(b - k * CHUNK, F.lit(CHUNK))
            return F.substr(F.get(chunks, k), lo + 1, hi - lo)
        last = F.floor((b - 1) / F.lit(CHUNK)).cast("int")
        return F.when(b > a, F.array_join(F.transform(F.sequence(F.floor(a / F.lit(CHUNK)).cast("int"), last), inside), "")).otherwise("")

    def put(chunks: Column) -> Column:
        done = F.transform(edits, lambda e, i: F.concat(piece(chunks, F.coalesce(F.get(edits, i - 1)["end"], F.lit(0)), e["start"]), e["new"]))
        return F.concat(F.array_join(done, ""), piece(chunks, F.get(edits, F.size(edits) - 1)["end"], F.length(text)))
    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), put)


def parts() -> str:
    return f"$1{OPEN}$2{CLOSE}$3"


def count_matches(text: Column, regex: str) -> Column:
    return F.regexp_count(text, F.lit(regex))


def context(text: Column, start: Column, end: Column, radius: int) -> tuple[Column, Column]:
    """Up to ``radius`` characters before and after a span."""
    lo = F.greatest(start - radius, F.lit(0))
    return F.substr(text, lo + 1, start - lo), F.substr(text, end + 1, F.lit(radius))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


BUCKET = 64


def _bucketed(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
    first = F.floor(col(start) / F.lit(BUCKET))
    return df.withColumn(name, F.explode(F.sequence(first, F.greatest(first, F.floor((col(end) - 1) / F.lit(BUCKET))))))


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], ls: str, le: str, rs: str, re: str) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose intervals [start, end) overlap; names of the two sides other than the keys must differ.

    An interval stands in every bucket of ``BUCKET`` characters that it touches, rows meet on (keys, bucket), and a pair counts only in the bucket where the
    later of the two begins.  So rows that lie apart never meet, no pair is made twice, and the intervals of one hot key are dealt over many tasks.
    """
    met = _bucketed(left, ls, le, "_bucket").join(_bucketed(right, rs, re, "_bucket"), [*keys, "_bucket"])
    own = F.col("_bucket") == F.floor(F.greatest(col(ls), col(rs)) / F.lit(BUCKET))
    return met.where(own & overlaps(col(ls), col(le), col(rs), col(re))).drop("_bucket")

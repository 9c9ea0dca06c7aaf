"""Date parsing as Columns; nothing here raises under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewarden.functions.text import fold_digits

# fixed values: the formats a temporal profile accepts, in order, as (shape, Spark pattern)
DATE_FORMATS = [
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:?\d{2})$", "yyyy-MM-dd'T'HH:mm:ss[XXX][XX]"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,6}$", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
]

# fixed values: strftime directives and their Spark letters
STRFTIME = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss",
            "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "E", "A": "EEEE", "j": "DDD",
            "z": "XX", "Z": "z", "%": "%"}


def strftime_to_java(fmt: str) -> str:
    """The Spark datetime pattern of a strftime format."""
    out, i, literal = [], 0, ""
    while i <= len(fmt):
        ch = fmt[i] if i < len(fmt) else ""
        if ch.isalpha():
            literal += ch
            i += 1
            continue
        if literal:
            out.append(f"'{literal}'")
            literal = ""
        if ch == "%":
            out.append(STRFTIME[fmt[i + 1]])
            i += 2
            continue
        out.append(ch)
        i += 1
    return "".join(out)


def parse_any(text: Column) -> Column:
    """Timestamp of a string in any accepted format, else null. The shape test keeps parsing off other values."""
    t = fold_digits(F.trim(text))
    return F.coalesce(*[F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(fmt))) for shape, fmt in DATE_FORMATS])

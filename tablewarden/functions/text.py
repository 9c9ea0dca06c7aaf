"""Text folding and shape Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
ARABIC_INDIC = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "01234567890123456789"
ARABIC_RANGE = r"[؀-ۿݐ-ݿࢠ-ࣿ]"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyy"
ARABIC_ALEF, ARABIC_ALEF_TO = "أإآٱىةؤئ", "اااايهوي"
ARABIC_MARKS = r"[ً-ْٰـ]"
NULLISH = ["NONE", "NAN", "N/A", "NULL", ""]


def fold_digits(c: Column) -> Column:
    return F.translate(c, ARABIC_INDIC, ASCII_DIGITS)


def profile_mask(c: Column, length: int = 64) -> Column:
    """Digits to 9, ASCII letters to A, the rest kept."""
    head = F.substring(fold_digits(c), 1, length)
    return F.translate(head, ASCII_DIGITS[:10] + LOWER + UPPER, "9" * 10 + "A" * 52)


def fingerprint_mask(c: Column) -> Column:
    """Digits to D, lower case to A, upper case to a, the rest kept."""
    return F.translate(c, ASCII_DIGITS[:10] + LOWER + UPPER, "D" * 10 + "A" * 26 + "a" * 26)


def memory_mask(c: Column) -> Column:
    """Digits to D, ASCII letters to L, white space to a blank, the rest kept."""
    letters = F.translate(c, LOWER + UPPER, "L" * 52)
    return F.regexp_replace(F.regexp_replace(letters, r"\p{Nd}", "D"), r"\s", " ")


def fold_name(c: Column) -> Column:
    """Column-name folding: lower case, accents and Arabic letter variants removed, separators to _."""
    t = F.translate(F.lower(c), ACCENTED, UNACCENTED)
    t = F.translate(F.regexp_replace(t, ARABIC_MARKS, ""), ARABIC_ALEF, ARABIC_ALEF_TO)
    return F.regexp_replace(F.trim(t), r"[\s\-.]+", "_")


def is_nullish(c: Column) -> Column:
    return c.isNull() | F.upper(F.trim(c)).isin(NULLISH)


def strip_chars(c: Column, extra: str) -> Column:
    """Remove separators that people type inside numbers; other characters stay and make the value invalid."""
    return F.regexp_replace(c, extra, "")


def safe_shape(c: Column) -> Column:
    """Length and token shape only: never a character of the value."""
    return F.concat(F.lit("n"), F.length(c).cast("string"), F.lit(":"), memory_mask(c))

"""Column expressions shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_SPACE = " \t\n\u000b\f\r"  # [\x20\x09-\x0D]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays (``lower`` would change letters beyond ASCII, so it serves ASCII texts only)."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def strip_space(c: Column) -> Column:
    return F.btrim(c, F.lit(ASCII_SPACE))


def word_count(c: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null and blank texts have none."""
    trimmed = strip_space(c)
    return F.when(trimmed.isNull() | (trimmed == ""), F.lit(0)) \
        .otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")

"""Column expressions over whole texts that several operators share (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and 0x09-0x0D."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.expr("array()").cast("array<string>")).otherwise(F.split(trimmed, BLANK + "+"))


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(""))


def free_name(taken: list[str], name: str) -> str:
    """A column name that clashes with none of ``taken``."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name

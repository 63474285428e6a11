"""Normal forms of keys and names: equal after trimming blanks and tabs and ignoring case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t"


def _trimmed(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(c, F.lit(BLANKS))


def key(col: Column | str) -> Column:
    """Trimmed and in upper case; a blank key is null."""
    t = F.upper(_trimmed(col))
    return F.when(t != "", t)


def name(col: Column | str) -> Column:
    """Trimmed and in lower case (bucket, source); a blank name is null."""
    t = F.lower(_trimmed(col))
    return F.when(t != "", t)


def letters(col: Column | str) -> Column:
    """A sequence with only its letters, in upper case; null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.upper(c), r"[^\p{L}]", "")


def entity(col: Column | str) -> Column:
    """A relation key by its letters and digits, in upper case; null where it has no digit."""
    c = F.col(col) if isinstance(col, str) else col
    t = F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]", "")
    return F.when(t.rlike(r"\p{N}"), t)

"""Trimming that covers every Unicode blank and control space, not only U+0020."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Valid in Java's and in RE2's syntax, so that SQL equivalents can share it.
SPACE = r"[\t-\r\x{85}\p{Z}]"


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}++|{SPACE}++\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(c, rf"{SPACE}++", " "))


def is_blank(c: Column) -> Column:
    """True for null and for text of white space only."""
    return F.coalesce(~c.rlike(r"[^\t-\r\x{85}\p{Z}]"), F.lit(True))

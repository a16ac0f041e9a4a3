"""Placeholders of a value as tokens, and how two values' tokens differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of placeholders, in the order in which they are read.
NAMED = {"doubleCurly": r"\{\{\s*([A-Za-z0-9_.-]+)\s*\}\}", "percentCurly": r"%\{([A-Za-z0-9_.-]+)\}"}
POSITIONAL = {"percentSymbol": "%s"}
FORMATS = ("doubleCurly", "percentCurly", "percentSymbol")


def extract(value: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """Distinct tokens in order; positional ones are numbered."""
    parts = []
    for f in formats:
        if f in NAMED:
            parts.append(F.regexp_extract_all(value, F.lit(NAMED[f]), F.lit(1)))
        else:
            found = F.regexp_extract_all(value, F.lit(POSITIONAL[f]), F.lit(0))
            parts.append(F.transform(found, lambda _, i: F.concat(F.lit("__positional__"), (i + 1).cast("string"))))
    return F.array_distinct(F.concat(*parts))


def missing(source: Column, target: Column) -> Column:
    return F.array_except(source, target)

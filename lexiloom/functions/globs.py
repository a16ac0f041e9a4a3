"""Glob patterns of keys and paths as anchored regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEY = {"**": ".*", "*": "[^.]*", "?": "[^.]"}


def key_regex(pattern: str) -> str:
    """`*` stays within a segment, `**` crosses dots, `?` is one character."""
    return "^" + re.sub(r"\*\*|\*|\?|[^*?]+", lambda m: _KEY.get(m.group(), re.escape(m.group())), pattern) + r"\z"


def path_regex(pattern: str) -> str:
    """`**/` is any number of folders, `*` and `?` stay within one, `{a,b}` are alternatives."""
    out, depth = [], 0
    for m in re.finditer(r"\*\*/|\*\*|\*|\?|\{|\}|,|[^*?{},]+", pattern):
        t = m.group()
        depth += (t == "{") - (t == "}")
        fixed = {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}
        out.append("|" if t == "," and depth else fixed.get(t) or re.escape(t))
    return "^" + "".join(out) + r"\z"


def matches_any(c: Column, regexes: list[str]) -> Column:
    out = F.lit(False)
    for r in regexes:
        out = out | c.rlike(r)
    return out

"""Column functions on configuration values, command lines, places in texts and small displays. Null gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.texts import java
from lexiloom.functions.whitespace import is_blank, trim_all

# Patterns of safe and unsafe configuration values, and their greatest length.
CONTROL = r"[\x00-\x1F\x7F]"
SHELL_META = "[;\"'`|&<>$]"
LANGUAGE_TAG = "^[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*$"
IDENTIFIER = "^[A-Za-z_$][A-Za-z0-9_$]*$"
NAMESPACE = "^[A-Za-z0-9._-]+$"
LONGEST_PATH = 320
# Signs that are no text.
HEX_COLOUR = "^#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"
HTML_ENTITY = "!^&[a-z][a-z0-9-]*;$"


def is_like(c: Column, pattern: str) -> Column:
    return c.rlike(java(pattern))


def is_unsafe(c: Column) -> Column:
    """Whether a value holds control characters or signs that a shell reads."""
    return c.rlike(CONTROL) | c.rlike(SHELL_META)


def path_problem(c: Column) -> Column:
    """empty, too-long or unsafe; null for a usable path."""
    return F.when(is_blank(c), "empty").when(F.length(c) > LONGEST_PATH, "too-long").when(is_unsafe(c), "unsafe")


def string_list(c: Column) -> Column:
    """The parts between commas, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(c, ","), trim_all), lambda x: x != "")


def positive_integer(c: Column) -> Column:
    """The integer part of a positive number; null for anything else."""
    n = F.when(c.rlike(r"^[0-9]{1,18}(?:\.[0-9]+)?\z"), F.split_part(c, F.lit("."), F.lit(1)).cast("long"))
    return F.when(n > 0, n)


def clamped(c: Column, least: int = 1, most: int = 200, default: int = 20) -> Column:
    """A limit inside its bounds; the default where it isn't a positive number."""
    n = positive_integer(c)
    return F.when(n.isNull(), default).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), n))).cast("int")


def value_kind(c: Column) -> Column:
    """What a value written on a command line is: boolean, null, number, json, quoted or string."""
    json = c.rlike(r"^(?s:\[.*\]|\{.*\})\z")
    quoted = (F.length(c) > 1) & (c.startswith('"') & c.endswith('"') | c.startswith("'") & c.endswith("'"))
    return F.when(c.isin("true", "false"), "boolean").when(c == "null", "null").when(c.rlike(r"^-?\d+(?:\.\d+)?\z"), "number").when(json & F.call_function("try_parse_json", c).isNotNull(), "json").when(quoted, "quoted").when(c.isNotNull(), "string")


def plain_value(c: Column) -> Column:
    """A value without the quotes around it."""
    return F.when(value_kind(c) == "quoted", c.substr(F.lit(2), F.length(c) - 2)).otherwise(c)


def path_parts(c: Column) -> Column:
    """The segments of a dotted path to a setting, without empty ones."""
    return F.filter(F.split(c, r"\."), lambda x: x != "")


def command_tokens(c: Column) -> Column:
    """The words of a command line; quoted parts are words of their own, in which a backslash takes the next sign as it is."""
    word = r"""(?s)"(?:\\.|[^"\\])*(?:"|\\?\z)|'(?:\\.|[^'\\])*(?:'|\\?\z)|[^\s"']+"""
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"""(?s)^(["'])((?:\\.|(?!\1)[^\\])*)(?:\1|\\?\z)$""", "$2"), r"(?s)\\(.)", "$1")
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(word), F.lit(0)), lambda x: F.when(x.rlike("^[\"']"), bare(x)).otherwise(x)), lambda x: x != "")


def line_of(text: Column, offset: Column) -> Column:
    """The line (from 0) of an offset (from 0) in a text."""
    return F.size(F.split(text.substr(F.lit(1), offset), "\n", -1)) - 1


def column_of(text: Column, offset: Column) -> Column:
    """The place (from 0) of an offset in its line."""
    return F.length(F.element_at(F.split(text.substr(F.lit(1), offset), "\n", -1), -1))


def relative_age(moment: Column, now: Column) -> Column:
    """How long ago a moment was, in words; the date from a day on."""
    s = F.unix_timestamp(now) - F.unix_timestamp(moment)
    ago = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 10, "just now").when(s < 60, ago(s, "s")).when(s < 3600, ago(s / 60, "m")).when(s < 86400, ago(s / 3600, "h")).otherwise(F.date_format(moment, "yyyy-MM-dd"))


def severity_text(errors: Column, warnings: Column, infos: Column) -> Column:
    """Counts by severity in words, without those that are zero."""
    many = lambda n, word: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s")))
    return F.concat_ws(", ", F.when(errors > 0, F.concat(errors.cast("string"), F.lit(" critical"))), many(warnings, "warning"), many(infos, "info"))


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of a value that is computed once, however often `f` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def unwrapped(c: Column) -> Column:
    """A value without quotes of one kind around it and, inside of them, round brackets; trimmed at each step."""
    inner = lambda t: trim_all(t.substr(F.lit(2), F.length(t) - 2))
    quoted = lambda t: F.when(t.rlike(r"""^(?s:`.*`|".*"|'.*')\z"""), inner(t)).otherwise(t)
    bracketed = lambda t: F.when(t.rlike(r"^\((?s:.*)\)\z"), inner(t)).otherwise(t)
    return _bound(_bound(trim_all(c), quoted), bracketed)


def static_path(c: Column) -> Column:
    """The path of keys an expression names: holes of templates as `*`, other signs dropped, dots and stars squeezed."""
    out = F.regexp_replace(F.regexp_replace(unwrapped(c), r"\$\{[^}]+\}", "*"), r"[^A-Za-z0-9_*.-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"\.{2,}", "."), r"\*{2,}", "*"), r"^\.", ""), r"\.\z", "")


def manual_assumption(c: Column) -> Column:
    """An assumption a person wrote, in the form in which assumptions are compared."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(unwrapped(c), r"\$\{[^}]+\}", "*"), r"\.{2,}", "."), r"\*{2,}", "*")
    return F.regexp_replace(F.regexp_replace(out, r"^\.", ""), r"\.\z", "")


def dynamic_assumption(expression: Column, reason: Column) -> tuple[Column, Column]:
    """(assumption, bucket) for a dynamic key: globs for templates, the left side of `||`, else a path; nulls if none is left."""
    e = trim_all(expression)
    template = (reason == "template") | (reason != "binary") & e.contains("${")
    told = F.when(reason == "binary", F.split_part(e, F.lit("||"), F.lit(1))).otherwise(e)
    made = F.nullif(static_path(told), F.lit(""))
    bucket = F.when(template, "globs").when(reason == "binary", "assumptions").when(made.contains("*"), "globs").otherwise("assumptions")
    return made, F.when(made.isNotNull(), bucket)


"""Column functions on source expressions, attributes and snippets. Null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions import globs
from lexiloom.functions.texts import first_match, java
from lexiloom.functions.whitespace import trim_all

# Attributes that never hold text for people, that always do, and endings that tell of such text.
DENIED_ATTRIBUTES = ("class", "classname", "style", "id", "key", "ref", "href", "src", "type", "name", "value", "for", "role", "slot", "is", "v-model")
ALLOWED_ATTRIBUTES = ("alt", "title", "placeholder", "label", "aria-label", "aria-description", "tooltip", "caption", "helper-text")
TEXT_ENDINGS = ("label", "text", "title", "message", "description", "placeholder", "tooltip", "hint", "caption")


# Fixed values: (reason, whether the text is taken untrimmed, pattern) in order of priority.
EXPRESSION_PATTERNS = (
    ("json-like-string", True, r'^\s*\{[\s\S]*"[\w-]+"[\s\S]*:[\s\S]*\}\s*$'),
    ("sql-like-string", True, r"!\b(SELECT|INSERT|UPDATE|DELETE|FROM|WHERE|JOIN|ORDER\s+BY|GROUP\s+BY)\b"),
    ("format-specifiers", False, r"^[%$]?[sdif](\s+[%$]?[sdif])*$"),
    ("phone-number", False, r"^[+]?\d{1,3}[\s.-]?\(?\d{1,4}\)?[\s.-]?\d{1,4}[\s.-]?\d{1,9}$"),
    ("regex-pattern", False, r"^/.*/[gimsuvy]*$"),
    ("i18n-call-pattern", False, r"""^(t|i18n|translate|\$t)\s*\(\s*['"`]"""),
)
# Fixed values: (reason, pattern) in order of priority.
TEMPLATE_PATTERNS = (
    ("json-like-content", r"^\s*[\[{][\s\S]*[\]}]\s*$"),
    ("code-like-content", r"\b(const|let|var|function|return|if|else|for|while)\b"),
    ("url-template", "!^(https?://|mailto:|tel:|ftp:)"),
)


def is_translatable_attribute(name: Column) -> Column:
    """Deny list, then allow list, then the ending of the name."""
    n = F.lower(name)
    ending = F.lit(False)
    for e in TEXT_ENDINGS:
        ending = ending | n.endswith(e)
    return F.when(n.isin(*DENIED_ATTRIBUTES), False).when(n.isin(*ALLOWED_ATTRIBUTES), True).otherwise(ending)


def is_html(text: Column) -> Column:
    return text.rlike(r"</?[a-zA-Z][^<>]*>|\{\{.*?\}\}|\bt\(")


def without_openers(text: Column) -> Column:
    """Opening brackets right before a placeholder are dropped, white space is collapsed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\(\s*\{", "{"), r"\[\s*\{", "{")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def format_placeholder(name: Column, style: str = "i18next") -> Column:
    """i18next `{{x}}`, icu `{x}`, printf `%s`."""
    if style == "printf":
        return F.when(name.isNotNull(), F.lit("%s"))
    return F.concat(F.lit("{{"), name, F.lit("}}")) if style == "i18next" else F.concat(F.lit("{"), name, F.lit("}"))


def assumption(expression: Column) -> Column:
    """A pattern for a dynamic key: template parts as `*`, of `a || b` the left side, dots and stars squeezed."""
    left = trim_all(F.split_part(expression, F.lit("||"), F.lit(1)))
    bare = F.regexp_replace(left, "^[`'\"]|[`'\"]\\z", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\$\{[^{}]*\}", "*"), r"\*+", "*"), r"\.+", ".")


def snippet(text: Column) -> Column:
    """A snippet without white space and braces, with one kind of quote."""
    return F.regexp_replace(F.regexp_replace(text, r"[\s{}]+", ""), "[`\"]", "'")


def literal_pattern(value: Column) -> Column:
    """An anchored regular expression that matches exactly the value."""
    return F.concat(F.lit("^"), F.regexp_replace(value, r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit("$"))


def is_component(full: Column, part: Column) -> Column:
    """Whether `part` stands in `full`, at its first occurrence, between dots or ends, and isn't the whole."""
    at = F.call_function("instr", full, part)
    before = full.substr(F.lit(1), at - 1)
    after = full.substr(at + F.length(part), F.length(full))
    return (at > 0) & (full != part) & ((before == "") | before.endswith(".")) & ((after == "") | after.startswith("."))


def preview(text: Column, length: int = 50) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 3), F.lit("..."))).otherwise(text)


def expression_reason(text: Column) -> Column:
    """Why the text of an inline expression isn't for people, or null."""
    t = trim_all(text)
    out = F.lit(None).cast("string")
    for reason, whole, pattern in reversed(EXPRESSION_PATTERNS):
        out = F.when((text if whole else t).rlike(java(pattern)), reason).otherwise(out)
    return out


def template_reason(text: Column) -> Column:
    """Why the text of a template isn't for people, or null."""
    return first_match(text, TEMPLATE_PATTERNS)


def path_matches(path: Column, patterns: list[str]) -> Column:
    """A path matches by itself or by its last part."""
    regexes = [globs.path_regex(p) for p in patterns]
    return globs.matches_any(path, regexes) | globs.matches_any(F.substring_index(path, "/", -1), regexes)

"""Rules that tell translatable text from everything else. Each rule list is data; a list becomes one CASE expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.whitespace import SPACE, trim_all

# Fixed values: (reason, pattern) in order of priority; `!` before a pattern marks case-insensitive ones.
FILTER_RULES_BEFORE_CLASSES = (
    ("html-entity", "!^&[a-z][a-z0-9-]*;$"),
    ("non_sentence", "!^(https?://|mailto:|tel:)"),
    ("non_sentence", r"^/[\w\-./]+(\?[\w=&]*)?$"),
    ("non_sentence", "!^(true|false|null|undefined)$"),
    ("non_sentence", r"(&&|\|\||===|!==|=>|\breturn\b|\bconst\b|\blet\b|\bvar\b|\bif\b|\belse\b)"),
)
FILTER_RULES_AFTER_CLASSES = (
    ("non_sentence", r"^--[\w-]+$"),
    ("non_sentence", r"^[MmLlHhVvCcSsQqTtAaZz\d\s.,\-]{9,}$"),
    ("non_sentence", r"!^\d+(\.\d+)?(px|em|rem|vh|vw|%|s|ms|fr)$"),
    ("non_sentence", r"!^[\d.]+(px|em|rem|%)(\s+[\d.]+(px|em|rem|%))*$"),
    ("non_sentence", r"!^[a-z][\w-]*:[a-z][\w-]*$"),
    ("non_sentence", "^[A-Z0-9_]*_[A-Z0-9_]*$"),
    ("non_sentence", r"^[\x{2700}-\x{27BF}\x{1F300}-\x{1FAFF}\x{231A}\x{231B}\x{23E9}-\x{23EC}\x{23F0}\x{23F3}\x{2614}\x{2615}\x{26A1}\x{2B50}]"),
    ("non_sentence", r"^on[A-Z]\w+$"),
    ("non_sentence", "^[a-z]+[A-Z][a-zA-Z]*$"),
    ("non_sentence", r"^[\w-]+(\.[\w-]+){2,}$"),
    ("non_sentence", r"!^[\w\s,\-]+,\s*(sans-serif|serif|monospace|cursive|fantasy|system-ui)$"),
    ("non_sentence", "!^(GET|POST|PUT|DELETE|PATCH|_blank|_self|_parent|_top|noopener|noreferrer)$"),
)
FILTER_RULES_LAST = (
    ("locale-code", "^[a-z]{2,3}$"),
    ("rel-attribute", r"!^(noopener|noreferrer|nofollow|noopener\s+noreferrer)$"),
    ("dom-event", r"!^on\w+$"),
    ("svg-attribute", "!^(evenodd|nonzero)$"),
    ("all-caps-constant", "^[A-Z][A-Z0-9_]*_[A-Z0-9_]*$"),
    ("css-transition", r"!^\w+\s+[\d.]+s?\s*(ease|linear|ease-in|ease-out)?$"),
)
# Words, signals and prefixes of style classes.
CSS_VALUES = (
    "bold normal italic center left right justify top bottom baseline middle flex grid block inline none hidden visible absolute relative "
    "fixed sticky transparent inherit initial unset auto wrap nowrap uppercase lowercase capitalize underline overline pointer default "
    "cover contain scroll smooth start end stretch"
).split()
UTILITY_SIGNALS = (
    r"(?i)\b(flex|grid|block|inline|hidden|absolute|relative|fixed|sticky)\b",
    r"(?i)\b(bg|text|border|rounded|shadow|ring|outline|p|m|w|h|gap|space)-",
    r"(?i)\b(hover|focus|active|disabled|dark|sm|md|lg|xl|2xl):",
    r"(?i)\bvar\(--",
)
CLASS_LIST = r"(?i)^(?:[A-Za-z0-9][\w:./\-\[\]()'#%,]*\s+)+[A-Za-z0-9][\w:./\-\[\]()'#%,]*$"
UTILITY_PREFIXES = (
    "flex grid block inline hidden p m w h gap space text bg border rounded shadow ring outline font leading tracking opacity z top right "
    "bottom left inset overflow cursor pointer select resize sr object break whitespace truncate animate transition duration ease delay "
    "scale rotate translate skew origin col row order justify items content self place float clear"
).split()
# Attributes whose values aren't text, and values that aren't text in an attribute.
OPAQUE_ATTRIBUTES = ("class", "classname", "style", "d", "viewbox")
HTML_TYPES = "text submit checkbox hidden number radio range button password email tel date time file search url color reset image".split()
CSS_KEYWORD = "!^(auto|inherit|initial|unset|none|block|flex|grid|inline|bold|normal|center|left|right|baseline)$"
INPUT_TYPE = "!^(text|email|password|number|tel|url|date|time|hidden|submit|button|checkbox|radio|file|range|color|search)$"
ICON = r"!^[a-z][\w-]*:[a-z][\w-]*$"
RELATIVE_PATH = r"^/[\w\-./]+(\?[\w=&]*)?$"
# Words of queries.
SQL_WORDS = r"\b(SELECT|INSERT|UPDATE|DELETE|FROM|WHERE|JOIN|ORDER\s+BY|GROUP\s+BY|CREATE|DROP|ALTER|TRUNCATE)\b"
# Fixed values: (name, category, confidence, pattern) in order of priority.
PATTERNS = (
    ("json-object", "data-structure", 0.95, r'^\s*\{[\s\S]*"[\w-]+"[\s\S]*:[\s\S]*\}\s*$'),
    ("json-array", "data-structure", 0.8, r"^\s*\[[\s\S]*\]\s*$"),
    ("xml-html", "data-structure", 0.9, r"^\s*<[a-zA-Z][\s\S]*>[\s\S]*</[a-zA-Z][\s\S]*>\s*$"),
    ("sql", "code", 0.95, "!" + SQL_WORDS),
    ("regex", "code", 0.9, "^/[^/]+/[gimsuvy]*$"),
    ("css-selector", "code", 0.7, r"^[#.]?[a-zA-Z_-][\w-]*(\s*[>+~]\s*[#.]?[a-zA-Z_-][\w-]*)*$"),
    ("xpath", "code", 0.9, r"^//[a-zA-Z][\w]*(\[.*\])?"),
    ("format-specifier", "technical", 0.95, r"^[%$]?[sdifbuoxXeEgGp](\s+[%$]?[sdifbuoxXeEgGp])*$"),
    ("log-format", "technical", 0.85, r"^\s*\[[A-Z]+\]\s*$"),
    ("version", "technical", 0.9, r"^v?\d+\.\d+(\.\d+)?(-[a-zA-Z0-9]+)?$"),
    ("date-format", "technical", 0.85, "!^[YMDHhms]{1,4}[-/:.][YMDHhms]{1,4}([-/:.][YMDHhms]{1,4})*$"),
    ("phone", "data-value", 0.85, r"^[+]?\d{0,3}[\s.-]?\(?\d{1,4}\)?[\s.-]?\d{1,4}[\s.-]?\d{1,9}$"),
    ("email", "data-value", 0.95, r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"),
    ("url", "data-value", 0.9, "!^(https?://|ftp://|mailto:|tel:|data:)"),
    ("ip-address", "data-value", 0.95, r"^(\d{1,3}\.){3}\d{1,3}(:\d+)?$"),
    ("uuid", "data-value", 0.99, "!^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
    ("hex-color", "data-value", 0.95, "!^#([0-9a-f]{3}|[0-9a-f]{6}|[0-9a-f]{8})$"),
    ("file-path", "data-value", 0.85, r"^[./][\w./\\-]+\.[a-zA-Z]{2,4}$|^[A-Z]:\\|^/[a-zA-Z]|^\.\./"),
    ("i18n-call", "already-i18n", 0.99, r"^(t|i18n|translate|\$t|useTranslation|useI18n)\s*\("),
    ("translation-key", "already-i18n", 0.7, "!^[a-z][a-z0-9]*([._][a-z][a-z0-9]*)+$"),
    ("emoji-only", "ui-element", 0.9, r"^[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}#*0-9\x{A9}\x{AE}\s]+$"),
    ("symbol-only", "ui-element", 0.9, r"^[^\p{L}\p{N}\s]+$"),
    ("html-entity", "ui-element", 0.95, "!^&[a-z][a-z0-9]*;$"),
    ("placeholder", "user-content", 0.9, r"!^\{\{[\w.]+\}\}$|^\{[\w.]+\}$|^%[a-z]$"),
)
# Named entities in the order in which they are replaced.
ENTITIES = (
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"),
    ("&trade;", "™"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&bull;", "•"),
)
# Letters of pseudo-localised text.
ACCENTS = ("aeiouAEIOU", "áéíóúÁÉÍÓÚ")


def java(pattern: str) -> str:
    """A rule's pattern for Spark: the case mark as a flag, ends that don't overlook a final line break."""
    flag = "(?i)" if pattern.startswith("!") else ""
    return flag + pattern.removeprefix("!").replace("$|", r"\z|").removesuffix("$") + (r"\z" if pattern.endswith("$") else "")


def first_match(text: Column, rules: tuple[tuple[str, str], ...], otherwise: Column | None = None) -> Column:
    out = otherwise if otherwise is not None else F.lit(None).cast("string")
    for reason, pattern in reversed(rules):
        out = F.when(text.rlike(java(pattern)), reason).otherwise(out)
    return out


def utility_signals(text: Column) -> Column:
    return sum((text.rlike(p).cast("int") for p in UTILITY_SIGNALS), F.lit(0))


def is_class_list(text: Column) -> Column:
    """Whether text reads as a list of style classes: enough of its tokens look like utility classes."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    like = text.rlike(java(CLASS_LIST)) & F.exists(tokens, lambda t: t.rlike(r"[-/\[]|:\w|\d"))
    some = (utility_signals(text) >= 1) | text.rlike(r"\[[\d.]+\]")
    # Bound once: each part is several regular expressions.
    parts = F.array(F.struct(F.size(tokens).alias("n"), like.alias("like"), some.alias("some")))
    judged = lambda p: F.when(p["like"] & (p["n"] >= 3), True).when(p["n"] < 2, p["like"] & p["some"]).otherwise(p["some"])
    return F.get(F.transform(parts, judged), F.lit(0))


def is_single_utility(text: Column) -> Column:
    return ~text.contains(" ") & text.rlike(rf"(?i)^({'|'.join(UTILITY_PREFIXES)})[-]?\d*[a-z0-9./\[\]-]*\z") & (text.rlike(r"\d") | text.rlike(rf"^({'|'.join(UTILITY_PREFIXES)})"))


def _attribute_reason(t: Column, attribute: Column) -> Column:
    """The rules that know where a text stands; null where none of them applies."""
    a = F.lower(attribute)
    of = lambda *names: a.isin(*names)
    like = lambda p: t.rlike(java(p))
    hit = of(*OPAQUE_ATTRIBUTES) | a.isNotNull() & like(CSS_KEYWORD) | of("type", "inputmode") & like(INPUT_TYPE) | of("icon", "iconname", "icon-name") & like(ICON) | of("href", "to", "action", "src") & like(RELATIVE_PATH)
    return F.when(F.coalesce(hit, F.lit(False)), "non_sentence")


def skip_reason(text: Column, *, attribute: Column | None = None, deny: tuple[str, ...] = (), allow: tuple[str, ...] = (), skip_hex: bool = False) -> Column:
    """Why a text isn't extracted, or null if it is. Null and empty texts are `empty`.

    `attribute` names the attribute a text is the value of, where it is one. Deny and allow patterns disregard case; those
    that aren't regular expressions are left out.
    """
    deny, allow = compiled(deny), compiled(allow)
    t = trim_all(text)
    placed = None if attribute is None else _attribute_reason(t, attribute)
    end = F.when(is_single_utility(t), "single-token-tailwind").when(~t.rlike(r"\p{L}"), "no-letters")
    last = first_match(t, FILTER_RULES_LAST, end if placed is None else end.otherwise(placed))
    last = F.when(F.lower(t).isin(*CSS_VALUES), "css-value-keyword").otherwise(last)
    if attribute is not None:
        last = F.when((F.lower(attribute) == "type") & F.lower(t).isin(*HTML_TYPES), "html-type-keyword").otherwise(last)
    if skip_hex:
        last = F.when(t.rlike(r"^#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})\z"), "hex-color").otherwise(last)
    last = F.when(t.rlike(r"^([^\p{L}\d\s])\1+\z"), "repeated-symbols").otherwise(last)
    middle = F.when(is_class_list(t), "non_sentence").otherwise(first_match(t, FILTER_RULES_AFTER_CLASSES, last))
    out = F.when(F.length(text) == 1, "single-character").otherwise(first_match(t, FILTER_RULES_BEFORE_CLASSES, middle))
    if allow:
        passes = F.lit(False)
        for p in allow:
            passes = passes | t.rlike(p)
        out = F.when(~passes, "allow-pattern-mismatch").otherwise(out)
    for p in reversed(deny):
        out = F.when(t.rlike(p), "deny-pattern").otherwise(out)
    return F.when(text.isNull() | (text == ""), "empty").otherwise(out)


def compiled(patterns: tuple[str, ...]) -> tuple[str, ...]:
    """The patterns that are regular expressions, without regard to case."""
    out = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        out.append("(?i)" + p)
    return tuple(out)


def before_query(text: Column) -> Column:
    """The text before an embedded query; text without one as it is."""
    word = F.regexp_extract(text, "(?i)" + SQL_WORDS, 1)
    cut = F.regexp_replace(F.regexp_extract(text, "(?is)^(.*?)" + SQL_WORDS, 1), rf"{SPACE}++\z", "")
    return F.when((word != "") & ((word == F.upper(word)) | text.rlike(r"""[=*'"]""")), cut).otherwise(text)


def pattern_set(*, enabled: tuple[str, ...] | None = None, disabled: tuple[str, ...] = (), skipped_categories: tuple[str, ...] = (), custom: tuple[tuple[str, str, float, str], ...] = ()) -> tuple[tuple[str, str, float, str], ...]:
    """The patterns in force: built-in ones by name and category, then custom ones that are regular expressions."""
    kept = [p for p in PATTERNS if (enabled is None or p[0] in enabled) and p[0] not in disabled and p[1] not in skipped_categories]
    return (*kept, *[p for p in custom if p[1] not in skipped_categories and compiled((p[3].removeprefix("!"),))])


def detected_pattern(text: Column, least: float = 0.8, patterns: tuple[tuple[str, str, float, str], ...] = PATTERNS) -> Column:
    """The first pattern (name, category, confidence) of non-translatable text that is sure enough."""
    out = F.lit(None).cast("struct<name:string,category:string,confidence:double>")
    for name, category, confidence, pattern in reversed(patterns):
        if confidence >= least:
            out = F.when(text.rlike(java(pattern)), F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


def detected_patterns(text: Column) -> Column:
    """The names of all patterns that match, the surest first, in order of the list among equals."""
    ranked = sorted(range(len(PATTERNS)), key=lambda i: (-PATTERNS[i][2], i))
    hits = F.array(*[F.when(text.rlike(java(PATTERNS[i][3])), F.lit(PATTERNS[i][0])) for i in ranked])
    return F.filter(hits, lambda x: x.isNotNull())


def confidence(text: Column, skipped: Column, forced: Column, least_letters: int = 2, least_ratio: float = 0.25) -> tuple[Column, Column]:
    """(bucket, score) of a candidate: what is skipped, forced, or rated by its letters and their share."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    ratio = letters / F.greatest(F.length(text), F.lit(1))
    rated = (
        F.when(letters < least_letters, F.lit(0.0))
        .when(ratio < least_ratio, 0.2)
        .when(letters >= max(least_letters * 2, least_letters + 3), 0.9)
        .when(ratio >= min(0.85, least_ratio + 0.35), 0.85)
        .when(letters >= least_letters + 2, 0.8)
        .otherwise(0.6)
    )
    score = F.when(skipped.isNotNull(), F.lit(0.0)).when(F.coalesce(forced, F.lit(False)), 0.5).otherwise(rated)
    rated_bucket = F.when(rated < 0.5, "skip").when(rated >= 0.8, "high").otherwise("review")
    bucket = F.when(skipped.isNotNull(), "skip").when(F.coalesce(forced, F.lit(False)), "review").otherwise(rated_bucket)
    return bucket, score


def decoded(text: Column) -> Column:
    """HTML entities as characters: decimal and hexadecimal references first, then the named ones one after the other."""
    whole = F.regexp_extract_all(text, F.lit(r"&#(?:\d{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(0))
    number = lambda e: F.when(e.rlike("^&#[xX]"), F.conv(F.regexp_extract(e, "^&#[xX]([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(e, "^&#([0-9]+);", 1)).cast("long")
    # UTF-16 pairs for code points beyond the basic plane, decoded as one.
    as_hex = lambda n: F.when(n < 0x10000, F.lpad(F.hex(n), 4, "0")).otherwise(F.concat(F.hex(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), F.hex(F.lit(0xDC00) + (n - 0x10000) % 1024)))
    valid = lambda n: (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    out = F.aggregate(F.array_distinct(whole), text, lambda acc, e: F.when(valid(number(e)), F.replace(acc, e, F.decode(F.unhex(as_hex(number(e))), "UTF-16BE"))).otherwise(acc))
    for name, sign in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def pseudo_localized(text: Column, locale: Column) -> Column:
    return F.concat(F.lit("["), locale, F.lit("] "), F.translate(text, *ACCENTS))

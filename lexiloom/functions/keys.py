"""Column functions on translation keys: suspicion, naming conventions, normalisation, values and digests from keys.

All stay inside code generation. Null keys give null results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.whitespace import collapse, trim_all

# Words that betray a sentence inside a key.
SENTENCE_WORDS = "The To Of For In On At By With From As Is Are Was Were Be Been Being Have Has Had Do Does Did Will Would Could Should May Might Must Shall Can".split()
# The forms of each naming convention.
CONVENTIONS = {"kebab-case": "^[a-z]+(-[a-z]+)*$", "snake_case": "^[a-z]+(_[a-z]+)*$", "camelCase": "^[a-z]+([A-Z][a-z]*)*$"}
# Lengths at which a hexadecimal segment is taken for a hash.
HASH_LENGTHS = (4, 6, 8, 12, 16, 32, 40, 64)
MAX_WORDS = 4
DEFAULT_NAMESPACE = "common"


def last_segment(key: Column) -> Column:
    return F.element_at(F.split(key, r"\.", -1), -1)


def namespace(key: Column) -> Column:
    """The part before the first dot; null for keys of one segment."""
    return F.when(key.contains("."), F.split_part(key, F.lit("."), F.lit(1)))


def suspicion(key: Column) -> Column:
    """Why a key looks like raw text, or null. The first reason that applies."""
    tail = last_segment(key)
    words = F.split(tail, "(?=[A-Z])")
    pascal = tail.rlike("([A-Z][a-z]+){3}") & ~tail.rlike("[-_]") & (F.size(words) >= 4) & F.forall(words, lambda w: F.length(w) > 1)
    return (
        F.when(key.contains(" "), "contains-spaces")
        .when(key.rlike(r"^[A-Za-z]+\z"), "single-word-no-namespace")
        .when(key.rlike(r"[:?!]\z"), "trailing-punctuation")
        .when(pascal, "pascal-case-sentence")
        .when(tail.rlike(rf"(?:^|[a-z])(?:{'|'.join(SENTENCE_WORDS)})(?:[A-Z]|\z)"), "sentence-article")
    )


def comparable(c: Column) -> Column:
    """Lower case, everything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def suspicion_with_value(key: Column, value: Column) -> Column:
    """As `suspicion`, where a key without namespace that equals its value has its own reason."""
    reason = suspicion(key)
    equal = ~key.contains(".") & ((key == value) | (comparable(key) == comparable(value)))
    return F.when(F.coalesce(equal, F.lit(False)) & (reason.isNull() | (reason == "single-word-no-namespace")), "key-equals-value").otherwise(reason)


def is_key_format(key: Column) -> Column:
    return key.rlike(r"^[a-zA-Z0-9._-]+\z")


def follows(part: Column, convention: str) -> Column:
    return part.rlike(CONVENTIONS[convention].replace("$", r"\z"))


def looks_like_hash(segment: Column) -> Column:
    return segment.rlike(r"^[0-9a-fA-F]+\z") & F.length(segment).isin(*HASH_LENGTHS)


def key_words(text: Column) -> Column:
    """The words of a key part in lower case, split at blanks, camel humps and ends of acronyms."""
    spaced = F.regexp_replace(text, r"""[:?!,.;'"]+""", " ")
    humps = F.regexp_replace(F.regexp_replace(spaced, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(collapse(humps)), " "), lambda w: w != "")


def normalized_key(key: Column, convention: str = "kebab-case", *, max_words: int = MAX_WORDS, default: str = DEFAULT_NAMESPACE, preserve: bool = False) -> Column:
    """A proper key made of raw text or of a suspicious key; a clean namespace is kept."""
    before = F.regexp_extract(key, r"^([a-zA-Z0-9._-]+)\.([^.]+)\z", 1)
    clean = before != ""
    space = F.when(clean, before).otherwise(default)
    part = F.when(clean, last_segment(key)).otherwise(key)
    words = F.slice(key_words(part), 1, max_words)
    if convention == "camelCase":
        joined = F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))), "")
    else:
        joined = F.array_join(words, "_" if convention == "snake_case" else "-")
    made = F.when(F.size(words) == 0, F.concat(space, F.lit(".unknown"))).otherwise(F.concat(space, F.lit("."), joined))
    if preserve:
        kept = F.lit(False)
        for c in CONVENTIONS:
            kept = kept | follows(part, c)
        made = F.when(kept, F.concat(space, F.lit("."), part)).otherwise(made)
    return made


def suggested_fix(key: Column, reason: Column) -> Column:
    return (
        F.when(reason == "single-word-no-namespace", F.concat(F.lit("common."), F.lower(key)))
        .when(reason == "trailing-punctuation", F.regexp_replace(key, r"[:?!]+\z", ""))
        .when(reason.isNotNull(), normalized_key(key))
    )


def safe_text(text: Column) -> Column:
    """Text without opening brackets at its end and closing ones at its start."""
    bare = F.regexp_replace(trim_all(text), r"[(\[{<]+\s*\z", "")
    return collapse(F.regexp_replace(bare, r"^\s*[)\]}>]+", ""))


def generated_key(text: Column, style: str = "snake", length: int = 50) -> Column:
    low = F.lower(safe_text(text))
    if style == "camel":
        parts = F.split(low, "[^a-z0-9]+", -1)
        # The first part stays as it is; a separator at the very end is kept out by the empty last part.
        made = F.array_join(F.transform(parts, lambda w, i: F.when((i == 0) | (w == ""), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))), "")
        made = F.concat(F.lower(F.substring(made, 1, 1)), made.substr(F.lit(2), F.length(made)))
    else:
        sign = "_" if style == "snake" else "-"
        made = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", sign), rf"^{sign}+|{sign}+\z", "")
    return F.substring(made, 1, length)


def text_hash(text: Column) -> Column:
    """The rolling 31-multiplier hash over UTF-16 units in 32 signed bits, its absolute value in base 36."""
    points = F.transform(F.split(text, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.ascii(c)).cast("long"))
    pair = lambda c: F.array(F.lit(0xD800) + F.shiftright(c - 0x10000, 10), F.lit(0xDC00) + (c - 0x10000) % 1024)
    codes = F.when(F.exists(points, lambda c: c > 0xFFFF), F.flatten(F.transform(points, lambda c: F.when(c > 0xFFFF, pair(c)).otherwise(F.array(c))))).otherwise(points)
    mask = F.lit(0xFFFFFFFF)
    folded = F.aggregate(F.when(text == "", F.array(F.lit(0).cast("long"))).otherwise(codes), F.lit(0).cast("long"), lambda a, c: ((a * 31) + c).bitwiseAND(mask))
    signed = F.when(folded >= 2**31, F.lit(2**32) - folded).otherwise(folded)
    return F.lower(F.conv(signed.cast("string"), 10, 36))


def slug(text: Column) -> Column:
    bare = F.regexp_replace(text, r"[<>{}]", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, "[^a-zA-Z0-9]+", "-"), r"^-+|-+\z", ""))


def digest(text: Column, kind: Column, context: Column, path: Column | None = None, length: int = 6) -> Column:
    parts = [collapse(text), kind, F.coalesce(context, F.lit("")), path if path is not None else F.lit("")]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, length)


def path_scope(path: Column) -> Column:
    """Up to four slugs of a path's tail, without a leading `src` and without `index`; null if none is left."""
    segments = F.split(F.regexp_replace(path, r"\.[^/.]+\z", ""), r"[\\/]")
    slugs = F.filter(F.transform(segments, lambda s: slug(trim_all(s))), lambda s: s != "")
    kept = F.filter(slugs, lambda s, i: (s != "index") & ~((i == 0) & (s == "src")))
    tail = F.when(F.size(kept) > 4, F.slice(kept, -4, 4)).otherwise(kept)
    return F.nullif(F.array_join(tail, "."), F.lit(""))


def full_key(space: str, path: Column, context: Column, text: Column, kind: Column, by_value: bool = True) -> Column:
    """namespace . path scope [. context] . slug of four words . hash"""
    words = F.array_join(F.slice(F.filter(F.split(slug(collapse(text)), "-"), lambda w: w != ""), 1, 4), "-")
    return F.concat_ws(".", F.lit(space), path_scope(path), F.nullif(slug(context), F.lit("")), F.nullif(words, F.lit("")), digest(text, kind, context, None if by_value else path))


def value_from_key(key: Column) -> Column:
    """A readable value: the rightmost segment that's no hash, as title words; the same word twice in a row counts once."""
    segments = F.split(key, r"\.", -1)
    plain = F.filter(segments, lambda s: ~looks_like_hash(s))
    base = F.when(F.size(plain) > 0, F.element_at(plain, -1)).otherwise(F.element_at(segments, -1))
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"[._\-/]+", " "), "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.split(collapse(F.regexp_replace(spaced, "[^a-zA-Z0-9 ]+", " ")), " "), lambda w: w != "")
    title = F.transform(words, lambda w: F.when((F.length(w) > 1) & (w == F.upper(w)), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))))
    kept = F.filter(title, lambda w, i: (i == 0) | (F.lower(F.get(title, i - 1)) != F.lower(w)))
    return F.array_join(kept, " ")


def dotted_parts(key: Column) -> Column:
    """Every contiguous run of segments of a key other than the key itself."""
    segments = F.split(key, r"\.", -1)
    n = F.size(segments)
    starts = F.sequence(F.lit(1), n)
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(segments, i, k), "."))))
    return F.filter(F.array_distinct(runs), lambda r: (r != key) & (r != ""))


def ancestors(key: Column) -> Column:
    """The proper prefixes of a dotted key."""
    segments = F.split(key, r"\.", -1)
    return F.when(F.size(segments) > 1, F.transform(F.sequence(F.lit(1), F.size(segments) - 1), lambda k: F.array_join(F.slice(segments, F.lit(1), k), "."))).otherwise(F.array().cast("array<string>"))

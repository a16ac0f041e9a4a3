"""Drift between the keys that code refers to and the catalogs: missing, unused, untranslated, empty, mismatched.

All lookups are equi-joins on key (or key and locale) whose both sides are aggregated to one row per key before, so a key
that is referenced by a third of all rows is one row in every join. Null keys never match anything; empty tables give
empty results; repeated rows change nothing but counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import globs, keys, placeholders
from lexiloom.functions.whitespace import is_blank, trim_all
from lexiloom.sources.relations import keyset, references_by_key

# Values that stand for a translation to come.
EMPTY_MARKERS = ("todo", "tbd", "fixme", "pending", "???")


def of_locale(catalog: DataFrame, locale: str) -> DataFrame:
    return catalog.where(F.col("locale") == locale)


def empty_reason(value: Column, markers: tuple[str, ...] = EMPTY_MARKERS) -> Column:
    """null, empty, whitespace or placeholder; null for a real value."""
    trimmed = trim_all(value)
    return F.when(value.isNull(), "null").when(value == "", "empty").when(trimmed == "", "whitespace").when(F.lower(trimmed).isin(*markers), "placeholder")


def missing_keys(refs: DataFrame, catalog: DataFrame, source: str = "en", assumed: DataFrame | None = None, ignore_empty: bool = False) -> DataFrame:
    """Keys in use that the source catalog lacks, or holds blank unless that is ignored."""
    used = references_by_key(refs)
    if assumed is not None:
        used = used.join(assumed.where("key is not null").select("key").distinct(), "key", "full_outer")
    have = of_locale(catalog, source).select("key", "value")
    joined = used.join(have, "key", "left")
    gone = F.col("value").isNull() if ignore_empty else is_blank(F.col("value"))
    return joined.where(gone).select("key", F.coalesce("n_references", F.lit(0)).alias("n_references"), "first_file", "first_line", "fallback", keys.suspicion(F.col("key")).alias("suspicion"))


def unreferenced(refs: DataFrame, catalog: DataFrame, assumed: DataFrame | None = None) -> DataFrame:
    return catalog.join(keyset(refs, assumed), "key", "left_anti")


def _split_unused(refs: DataFrame, catalog: DataFrame, source: str, assumed: DataFrame | None) -> DataFrame:
    """Unreferenced rows with `untranslated`: a blank target whose source has a value."""
    rows = unreferenced(refs, catalog, assumed)
    src = rows.where(F.col("locale") == source).select("key", F.col("value").alias("source_value"))
    blank = (F.col("locale") != source) & is_blank(F.col("value")) & ~is_blank(F.col("source_value"))
    return rows.join(src, "key", "left").withColumn("untranslated", blank)


def _locales_of(rows: DataFrame) -> DataFrame:
    # The set of locales is bounded by the catalog's locales, not by its rows.
    return rows.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("locale")), ",").alias("locales"), F.count("*").alias("n_locales"))


def unused_keys(refs: DataFrame, catalog: DataFrame, source: str = "en", assumed: DataFrame | None = None) -> DataFrame:
    return _locales_of(_split_unused(refs, catalog, source, assumed).where(~F.col("untranslated")))


def untranslated_keys(refs: DataFrame, catalog: DataFrame, source: str = "en", assumed: DataFrame | None = None) -> DataFrame:
    return _locales_of(_split_unused(refs, catalog, source, assumed).where("untranslated"))


def source_target_pairs(catalog: DataFrame, source: str = "en") -> DataFrame:
    src = of_locale(catalog, source).select("key", F.col("value").alias("source_value"))
    return catalog.where(F.col("locale") != source).select("key", "locale", F.col("value").alias("target_value")).join(src, "key")


def placeholder_issues(catalog: DataFrame, source: str = "en", formats: tuple[str, ...] = placeholders.FORMATS) -> DataFrame:
    """Pairs of source and target whose sets of placeholders differ, with both differences."""
    pairs = source_target_pairs(catalog, source).withColumn("s", placeholders.extract(F.col("source_value"), formats)).withColumn("t", placeholders.extract(F.col("target_value"), formats))
    both = pairs.withColumn("gone", placeholders.missing(F.col("s"), F.col("t"))).withColumn("extra", placeholders.missing(F.col("t"), F.col("s")))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return both.where((F.size("gone") > 0) | (F.size("extra") > 0)).select("key", "locale", joined("gone").alias("missing"), joined("extra").alias("extra"))


def empty_values(refs: DataFrame, catalog: DataFrame, source: str = "en") -> DataFrame:
    rows = catalog.where(F.col("locale") != source).withColumn("reason", empty_reason(F.col("value"))).where("reason is not null")
    return rows.join(references_by_key(refs).select("key", "fallback"), "key", "left").select("key", "locale", "reason", "fallback")


def suspicious_refs(refs: DataFrame) -> DataFrame:
    """One row per reference to a suspicious key; the rule is a projection, so nothing is joined."""
    return refs.withColumn("reason", keys.suspicion(F.col("key"))).where("reason is not null").select("key", "file_path", "line", "col_no", "reason")


def key_value_audit(refs: DataFrame, catalog: DataFrame, source: str = "en") -> DataFrame:
    """Source keys that equal their value, at their first reference, else at the catalog itself (line 0)."""
    rows = of_locale(catalog, source).where(keys.suspicion_with_value(F.col("key"), F.col("value")) == "key-equals-value")
    first = references_by_key(refs).select("key", "first_file", "first_line")
    return rows.join(first, "key", "left").select("key", "value", F.coalesce("first_file", F.lit("catalog")).alias("file_path"), F.coalesce("first_line", F.lit(0)).alias("line"))


def recovered_values(refs: DataFrame, catalog: DataFrame, source: str = "en") -> DataFrame:
    """For missing keys the longest unused source key that is a dotted component of it, and its value.

    The components of a missing key are exploded (their number is bounded by its segments) and equi-joined.
    """
    gone = missing_keys(refs, catalog, source).select("key")
    spare = of_locale(unreferenced(refs, catalog), source).where(F.col("value") != "").select(F.col("key").alias("part"), "value")
    best = F.max(F.struct(F.length("part").alias("n"), F.col("part"), F.col("value")))
    found = gone.select("key", F.explode(keys.dotted_parts(F.col("key"))).alias("part")).join(spare, "part").groupBy("key").agg(best.alias("best"))
    return found.select("key", F.col("best.part").alias("from_key"), F.col("best.value").alias("recovered"))


def expanded_keys(patterns: DataFrame) -> DataFrame:
    """pattern, key: every `*` replaced by each value; a pattern without `*` is itself. Patterns: pattern, values (array).

    A pattern without any value gives nothing, whether it has a `*` or not.
    """
    patterns = patterns.where(F.size("values") > 0)
    whole = patterns.where(~F.col("pattern").contains("*")).select("pattern", F.col("pattern").alias("key"))
    wild = patterns.where(F.col("pattern").contains("*")).select("pattern", F.explode("values").alias("v")).select("pattern", F.replace("pattern", F.lit("*"), F.col("v")).alias("key"))
    return whole.unionByName(wild).distinct()


def dynamic_coverage(patterns: DataFrame, catalog: DataFrame) -> DataFrame:
    """pattern, locale, n_missing: expanded keys that a locale lacks, for the pairs that lack any.

    Keys are counted, not crossed with locales: what a locale has is joined on key, the rest is the difference.
    """
    wanted = expanded_keys(patterns)
    sizes = wanted.groupBy("pattern").agg(F.count("*").alias("n"))
    have = wanted.join(catalog.select("key", "locale"), "key").groupBy("pattern", "locale").agg(F.count("*").alias("n_have"))
    grid = sizes.select("pattern", "n", F.explode(every_locale(catalog)).alias("locale"))
    lacking = F.col("n") - F.coalesce("n_have", F.lit(0))
    return grid.join(have, ["pattern", "locale"], "left").where(lacking > 0).select("pattern", "locale", lacking.alias("n_missing"))


def glob_assumed_keys(catalog: DataFrame, patterns: list[str]) -> DataFrame:
    return catalog.where(globs.matches_any(F.col("key"), [globs.key_regex(p) for p in patterns])).select("key").distinct()


def every_locale(catalog: DataFrame) -> Column:
    """All locales as one array, by a scalar subquery; their number is that of the catalog's files."""
    return catalog.agg(F.array_sort(F.collect_set("locale")).alias("everywhere")).scalar()


def key_gaps(catalog: DataFrame) -> DataFrame:
    """locale, key: keys that some locale has and this one lacks. Each key's own locales are set against all locales."""
    own = catalog.groupBy("key").agg(F.collect_set("locale").alias("own"))
    return own.select("key", F.explode(F.array_except(every_locale(catalog), F.col("own"))).alias("locale")).select("locale", "key")


def locale_consistency(catalog: DataFrame) -> DataFrame:
    """locale, n_missing, first_missing."""
    return key_gaps(catalog).groupBy("locale").agg(F.count("*").alias("n_missing"), F.min("key").alias("first_missing"))


def seeded_targets(catalog: DataFrame, source: str = "en", seed: str = "", overwrite: bool = False) -> DataFrame:
    """locale, key, value to write: source keys a target lacks (all of them when overwriting)."""
    targets = catalog.where(F.col("locale") != source)
    keys_of = of_locale(catalog, source).select("key")
    if overwrite:
        return keys_of.select(F.explode(every_locale(targets)).alias("locale"), "key", F.lit(seed).alias("value"))
    return key_gaps(catalog).where(F.col("locale") != source).join(keys_of, "key", "left_semi").select("locale", "key", F.lit(seed).alias("value"))


def scoped(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References of the given files only; `files` has file_path."""
    return refs.join(files.select("file_path").distinct(), "file_path", "left_semi")


def selected(items: DataFrame, selection: DataFrame | None) -> DataFrame:
    """Items whose key is selected; all of them without a selection."""
    return items if selection is None else items.join(selection.select("key").distinct(), "key", "left_semi")


def locale_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """locale, key, change: added, removed or updated."""
    b = before.select("locale", "key", F.col("value").alias("old"))
    a = after.select("locale", "key", F.col("value").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "updated")
    return b.join(a, ["locale", "key"], "full_outer").withColumn("change", change).where("change is not null").select("locale", "key", "change")


def locale_preview(before: DataFrame, after: DataFrame) -> DataFrame:
    """locale, added, removed (numbers of keys), for locales where any changed."""
    d = locale_diff(before, after).where("change <> 'updated'")
    return d.groupBy("locale").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))


def applied(refs: DataFrame, catalog: DataFrame, source: str = "en", prune: bool = True, seed: str | None = "") -> DataFrame:
    """The projected catalog after adding missing source keys and pruning unused ones.

    A missing key takes the fallback literal, else the recovered value, else a value made of the key. Seeding adds new
    source keys to the other locales. Untranslated keys are never pruned.
    """
    gone = missing_keys(refs, catalog, source).join(recovered_values(refs, catalog, source).select("key", "recovered"), "key", "left")
    made = F.coalesce("fallback", "recovered", F.nullif(keys.value_from_key(F.col("key")), F.lit("")), "key")
    new = gone.select(F.lit(source).alias("locale"), "key", made.alias("value"))
    kept = catalog.select("locale", "key", "value")
    if prune:
        dead = _split_unused(refs, catalog, source, None).where(~F.col("untranslated")).select("locale", "key")
        kept = kept.join(dead, ["locale", "key"], "left_anti")
    merged = kept.join(new.select("locale", "key"), ["locale", "key"], "left_anti").unionByName(new)
    return merged if seed is None else merged.unionByName(seeded_targets(merged, source, seed))

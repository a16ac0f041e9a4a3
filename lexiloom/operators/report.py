"""Reports on findings and catalogs: exit codes, health, coverage, counts by file, suggestions on patterns, documents.

Findings are the rows of `rollup.actionable_items` or of the references. Everything is an aggregation with few rows per
group; nothing is gathered but what a report shows, whose size is its stated limit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.functions import config
from lexiloom.functions.whitespace import is_blank
from lexiloom.operators import quality, sync

# Order and codes of findings in strict mode.
STRICT_CODES = (("suspicious-key", 4), ("placeholder-mismatch", 2), ("empty-value", 3), ("missing-key", 1), ("unused-key", 1))
SEVERITIES = ("error", "warn", "info")


def strict_exit(items: DataFrame) -> DataFrame:
    """exit_code: that of the first kind of finding, in the order of strict mode, that occurs; 0 without any. One row."""
    found = items.agg(*[F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False)).alias(f"k{i}") for i, (k, _) in enumerate(STRICT_CODES)])
    code = F.lit(0)
    for i, (_, c) in reversed(list(enumerate(STRICT_CODES))):
        code = F.when(F.col(f"k{i}"), c).otherwise(code)
    return found.select(code.alias("exit_code"))


def drift_stats(items: DataFrame) -> DataFrame:
    """n_missing, n_unused: no row where both are zero."""
    counts = items.agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("missing-key", "n_missing"), ("unused-key", "n_unused"))])
    return counts.where("n_missing > 0 or n_unused > 0")


def health(items: DataFrame) -> DataFrame:
    """has_drift, has_conflicts, n_items, n_keys, summary (counts in words). One row."""
    counts = items.agg(
        F.coalesce(F.bool_or(F.col("kind").isin("missing-key", "unused-key")), F.lit(False)).alias("has_drift"),
        F.coalesce(F.bool_or(F.col("kind") == "placeholder-mismatch"), F.lit(False)).alias("has_conflicts"),
        F.count("*").alias("n_items"),
        F.countDistinct("key").alias("n_keys"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES],
    )
    return counts.select("has_drift", "has_conflicts", "n_items", "n_keys", config.severity_text(*[F.col(s) for s in SEVERITIES]).alias("summary"))


def unique_items(items: DataFrame) -> DataFrame:
    """kind, key, locale, severity, n_copies: findings of one kind, key and locale count once, with the gravest severity."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    grouped = items.groupBy("kind", "key", "locale").agg(F.min(rank).alias("r"), F.count("*").alias("n_copies"))
    return grouped.select("kind", "key", "locale", F.get(F.array(*map(F.lit, SEVERITIES)), F.col("r").cast("int") - 1).alias("severity"), "n_copies")


def file_issues(refs: DataFrame, catalog: DataFrame, source: str = "en") -> DataFrame:
    """file_path, n_references, n_missing, n_suspicious: references to keys without a source value or of a suspicious form, by file."""
    gone = sync.missing_keys(refs, catalog, source).select("key", F.lit(1).alias("gone"), F.col("suspicion").isNotNull().cast("int").alias("odd"))
    odd = sync.suspicious_refs(refs).select("key").distinct().withColumn("suspicious", F.lit(1))
    # References of one key and file are counted before the join, so neither a popular key nor a popular file is a burden.
    counts = refs.where("key is not null").groupBy("file_path", "key").agg(F.count("*").alias("n"))
    rows = counts.join(gone, "key", "left").join(odd, "key", "left")
    part = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return rows.groupBy("file_path").agg(F.sum("n").alias("n_references"), part("gone").alias("n_missing"), part("suspicious").alias("n_suspicious")).where("n_missing > 0 or n_suspicious > 0")


def coverage(catalog: DataFrame, source: str = "en") -> DataFrame:
    """locale, n_source, n_covered, share: how many source keys with a value each other locale has a value for."""
    wanted = sync.of_locale(catalog, source).where(~is_blank(F.col("value"))).select("key")
    total = wanted.agg(F.count("*").alias("n")).scalar()
    held = catalog.where((F.col("locale") != source) & ~is_blank(F.col("value"))).join(wanted, "key", "left_semi").groupBy("locale").agg(F.count("*").alias("n_covered"))
    every = catalog.where(F.col("locale") != source).select("locale").distinct()
    covered = F.coalesce("n_covered", F.lit(0))
    return every.join(held, "locale", "left").select("locale", total.alias("n_source"), covered.alias("n_covered"), F.when(total > 0, covered / total).otherwise(1.0).alias("share"))


def quality_report(catalog: DataFrame) -> DataFrame:
    """locale, check, subject, n: the findings of all checks of catalogs, one row each."""
    every = F.lit(None).cast("string").alias("locale")
    parts = [
        quality.duplicate_values(catalog).select("locale", F.lit("duplicate-value").alias("check"), F.col("value").alias("subject"), F.col("n_keys").alias("n")),
        sync.locale_consistency(catalog).select("locale", F.lit("missing-keys").alias("check"), F.col("first_missing").alias("subject"), F.col("n_missing").alias("n")),
        quality.orphaned_namespaces(catalog).select(every, F.lit("orphaned-namespace").alias("check"), F.col("namespace").alias("subject"), F.col("n_keys").alias("n")),
        quality.namespace_case_variants(catalog.select("key").distinct()).select(every, F.lit("case-variants").alias("check"), F.col("namespace").alias("subject"), F.size(F.split("variants", ",")).cast("long").alias("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


def equal_catalogs(before: DataFrame, after: DataFrame) -> DataFrame:
    """locale, equal: whether a locale has the same keys and values in both."""
    changed = sync.locale_diff(before, after).groupBy("locale").agg(F.count("*").alias("n"))
    every = before.select("locale").unionByName(after.select("locale")).distinct()
    return every.join(changed, "locale", "left").select("locale", F.col("n").isNull().alias("equal"))


def shape_guess(catalog: DataFrame, most: int = 50) -> DataFrame:
    """n_locales, largest, shape: flat, or auto where any locale has more than `most` keys."""
    sizes = catalog.groupBy("locale").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_locales"), F.max("n").alias("largest")).select("n_locales", "largest", F.when(F.col("largest") > most, "auto").otherwise("flat").alias("shape"))


def pattern_advice(matches: DataFrame) -> DataFrame:
    """pattern, advice: what may be wrong with patterns of files (pattern, side, n_files); `*` for advice on all of them."""
    include = matches.where("side = 'include'")
    p = F.col("pattern")
    fix = F.when(p.startswith("src/"), "check-source-folder").when(p.contains(".tsx"), "try-jsx").when(p.contains("/**") & ~p.contains("/**/"), "recurse-with-slashes").otherwise("no-such-files")
    tests = F.array_compact(F.array(F.when(F.col("n_files") == 0, fix), F.when(p.startswith("/"), F.lit("leading-slash")), F.when(p.contains("\\"), F.lit("backslash"))))
    total = matches.agg(F.sum(F.when(F.col("side") == "include", F.col("n_files")).otherwise(0)).alias("i"), F.sum(F.when(F.col("side") == "exclude", F.col("n_files")).otherwise(0)).alias("x"))
    broad = total.where((F.col("i") > 0) & (F.col("x") > 0.9 * F.col("i"))).select(F.lit("*").alias("pattern"), F.lit("excludes-too-broad").alias("advice"))
    return include.select("pattern", F.explode(tests).alias("advice")).unionByName(broad)


def requested_locales(catalog: DataFrame, requested: list[str], source: str = "en") -> DataFrame:
    """locale: the requested ones among the targets; all targets where none of these was asked for."""
    targets = catalog.where(F.col("locale") != source).select("locale").distinct()
    wanted = targets.where(F.col("locale").isin(requested))
    any_wanted = wanted.agg(F.count("*") > 0).scalar()
    return targets.where(F.col("locale").isin(requested) | ~any_wanted)


def ordered_items(items: DataFrame, limit: int | None = None) -> DataFrame:
    """The findings by severity, then kind, key and locale; at most `limit` of them where that is asked for."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    out = items.orderBy(rank, "kind", "key", "locale")
    return out if limit is None else out.limit(limit)


def newest(rows: DataFrame, by: str, keep: int = 5) -> DataFrame:
    """Rows with `rank` (1 is the last in order of `by`) and `kept`; only the rows to keep are ever in one place."""
    last = rows.orderBy(F.desc(by)).limit(keep).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(by))))
    return rows.join(F.broadcast(last.select(by, "rank")), by, "left").withColumn("kept", F.col("rank").isNotNull())


def as_json(items: DataFrame) -> DataFrame:
    """kind, document: the findings of a kind as one JSON line each."""
    return items.select("kind", F.to_json(F.struct("kind", "severity", "key", "locale"), {"ignoreNullFields": "false"}).alias("document"))


def markdown_summary(counts: DataFrame) -> DataFrame:
    """line: a table of findings by kind and severity (kind, severity, n_items), one line of mark-up each."""
    return counts.select(F.concat(F.lit("| "), F.col("kind"), F.lit(" | "), F.col("severity"), F.lit(" | "), F.col("n_items").cast("string"), F.lit(" |")).alias("line"))


def resolved_keys(candidates: DataFrame, catalog: DataFrame, attempts: int = 5) -> DataFrame:
    """key, made, attempts, status of the distinct keys to be added (key): moved out of the way of keys the catalog holds.

    A key below one that holds a value loses its last dot to an underscore; a key above others gets `_text`. After `attempts`
    moves a key that still collides is skipped. Each move is one pass over the keys that collide, by equi-joins.
    """
    held = catalog.select("key").distinct()
    above = held.select(F.explode(_prefixes(F.col("key"))).alias("made")).distinct().withColumn("container", F.lit(True))
    leaves = held.select(F.col("key").alias("prefix"), F.lit(True).alias("leaf"))

    def collisions(rows: DataFrame) -> DataFrame:
        under = rows.select("made", F.explode(_prefixes(F.col("made"))).alias("prefix")).join(leaves, "prefix").select("made").distinct().withColumn("under", F.lit(True))
        return rows.join(under, "made", "left").join(above, "made", "left")

    rows = candidates.where("key is not null").select("key").distinct().select("key", F.col("key").alias("made"), F.lit(0).alias("attempts"))
    for i in range(1, attempts + 1):
        flat = F.when(F.col("made").contains("."), F.regexp_replace("made", r"\.([^.]*)\z", "_$1")).otherwise(F.concat("made", F.lit(f"_{i}")))
        moved = F.when(F.col("under"), flat).when(F.col("container"), F.concat("made", F.lit("_text"))).otherwise(F.col("made"))
        rows = collisions(rows).select("key", moved.alias("made"), (F.col("attempts") + (F.col("under").isNotNull() | F.col("container").isNotNull()).cast("int")).alias("attempts"))
    stuck = F.col("under").isNotNull() | F.col("container").isNotNull()
    return collisions(rows).select("key", "made", "attempts", F.when(stuck, "skipped").when(F.col("attempts") > 0, "moved").otherwise("free").alias("status"))


def _prefixes(c):
    """The proper dotted prefixes of a key."""
    parts = F.split(c, r"\.", -1)
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), ".")), lambda x: x != c)

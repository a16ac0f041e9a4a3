"""What a project is made of: its files by pattern, how its code uses translations, packages, cache headers.

Files: file_path, text. Sums and examples are aggregates with bounded state; no file's text leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import expressions, globs

# Header fields of a cache in the order in which they are compared, the reason each gives, and whether it must be there.
HEADER = (("version", "version", True), ("identifier", "translationIdentifier", True), ("config_hash", "config", False), ("tool_version", "toolVersion", False), ("parser_signature", "parserSignature", False), ("parsers", "parserAvailability", False))


def matched_files(files: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """file_path of the distinct files that an include pattern matches and no exclude pattern does."""
    rows = files.where(expressions.path_matches(F.col("file_path"), include))
    return (rows.where(~expressions.path_matches(F.col("file_path"), exclude)) if exclude else rows).select("file_path").distinct()


def pattern_matches(files: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """pattern, side, n_files: how many distinct files each pattern matches; patterns without a file have 0."""
    both = [(p, "include") for p in include] + [(p, "exclude") for p in exclude]
    counts = files.select("file_path").distinct().agg(*[F.count_if(F.col("file_path").rlike(globs.path_regex(p))).alias(f"n{i}") for i, (p, _) in enumerate(both)])
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(s).alias("side"), F.col(f"n{i}").alias("n_files")) for i, (p, s) in enumerate(both)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def translation_usage(fragments: DataFrame) -> DataFrame:
    """call, n_matches, n_rows, first_file: how often translation calls occur."""
    kinds = {"t": r"(?:^|[^\w$.])t\(", "hook": r"\buse[A-Z]\w*\(", "toast": r"\bshowToast\("}
    rows = fragments.where("text is not null")
    counted = rows.select("file_path", F.explode(F.array(*[F.struct(F.lit(k).alias("call"), F.regexp_count("text", F.lit(p)).alias("n")) for k, p in kinds.items()])).alias("c")).where("c.n > 0")
    return counted.groupBy("c.call").agg(F.sum("c.n").alias("n_matches"), F.count("*").alias("n_rows"), F.min("file_path").alias("first_file"))


def extensions(files: DataFrame) -> DataFrame:
    """extension, n_files, share of all distinct files."""
    from pyspark.sql.window import Window

    one = files.select("file_path").distinct()
    counts = one.groupBy(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)\z", 1).alias("extension")).agg(F.count("*").alias("n_files"))
    # The window runs over one row per extension.
    return counts.withColumn("share", F.col("n_files") / F.sum("n_files").over(Window.partitionBy(F.lit(1))))


def dependencies(manifests: DataFrame) -> DataFrame:
    """path, name, version, section of package manifests (path, text); a package in both sections counts as a dependency."""
    both = "struct<dependencies:map<string,string>,devDependencies:map<string,string>>"
    parsed = manifests.select("path", F.from_json("text", both).alias("m"))
    main = parsed.select("path", F.explode("m.dependencies").alias("name", "version"), F.lit("dependencies").alias("section"))
    dev = parsed.select("path", F.explode("m.devDependencies").alias("name", "version"), F.lit("devDependencies").alias("section"))
    return main.unionByName(dev.join(main.select("path", "name"), ["path", "name"], "left_anti"))


def invalidation_reasons(cached: DataFrame, current: dict[str, str]) -> DataFrame:
    """identifier, reasons: why each cached header (one column per field) doesn't match the current one; '' if it does.

    A version or identifier that the cached header lacks doesn't match; other fields are compared only where both have them.
    """
    other = {c: ~F.col(c).eqNullSafe(F.lit(current[c])) if needed else F.col(c) != F.lit(current[c]) for c, _, needed in HEADER if needed or current.get(c) is not None}
    tests = [F.when(other[c], F.lit(r)) for c, r, _ in HEADER if c in other and c in cached.columns]
    keep = [c for c in cached.columns if c not in {h[0] for h in HEADER} or c == "identifier"]
    return cached.select(*keep, F.concat_ws(",", *tests).alias("reasons"))


def source_language(catalog: DataFrame) -> DataFrame:
    """locale: en, else a region of it, else the locale with most keys (the first in order of code among equals)."""
    counts = catalog.groupBy("locale").agg(F.count("*").alias("n"))
    rank = F.when(F.lower("locale") == "en", 0).when(F.lower("locale").isin("en-us", "en-gb"), 1).otherwise(2)
    return counts.agg(F.min(F.struct(rank.alias("rank"), F.when(rank < 2, 0).otherwise(-F.col("n")).alias("n"), "locale")).alias("b")).where("b is not null").select("b.locale")

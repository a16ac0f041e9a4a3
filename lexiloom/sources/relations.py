"""The base relations in the shape that operators take them: one value per (locale, key), references, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def catalog(raw: DataFrame) -> DataFrame:
    """locale, key, value, ord of a raw catalog; of several rows for (locale, key) the one with the last `ord` counts.

    Equal `ord`s are decided by the greater value. Rows without locale or key are left out; a null value is ''.
    """
    kept = raw.where("locale is not null and key is not null")
    last = F.max(F.struct("ord", F.coalesce("value", F.lit("")).alias("value")))
    return kept.groupBy("locale", "key").agg(last.alias("last")).select("locale", "key", F.col("last.value").alias("value"), F.col("last.ord").alias("ord"))


def keyset(refs: DataFrame, assumed: DataFrame | None = None) -> DataFrame:
    """The distinct keys in use: referenced ones and those assumed otherwise."""
    keys = refs.where("key is not null").select("key")
    return (keys.unionByName(assumed.select("key")) if assumed is not None else keys).distinct()


def references_by_key(refs: DataFrame) -> DataFrame:
    """key, n_references, first_file, first_line, fallback (of the first reference that has one), by `ord`.

    Aggregated before the shuffle, so that a popular key is no burden; references themselves are never collected.
    """
    place = F.struct("ord", "file_path", "line")
    return (
        refs.where("key is not null")
        .groupBy("key")
        .agg(F.count("*").alias("n_references"), F.min(place).alias("first"), F.min(F.when(F.col("fallback_literal").isNotNull(), F.struct("ord", "fallback_literal"))).alias("literal"))
        .select("key", "n_references", F.col("first.file_path").alias("first_file"), F.col("first.line").alias("first_line"), F.col("literal.fallback_literal").alias("fallback"))
    )

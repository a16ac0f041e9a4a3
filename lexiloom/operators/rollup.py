"""Rollups of findings: actionable items with severities, counts, dominant severity, top reasons, hit rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import texts
from lexiloom.operators import sync


def actionable_items(refs: DataFrame, catalog: DataFrame, source: str = "en") -> DataFrame:
    """kind, severity, key, locale: one row per finding of the sync."""
    none = F.lit(None).cast("string")
    item = lambda df, kind, severity, locale=none: df.select(F.lit(kind).alias("kind"), (severity if not isinstance(severity, str) else F.lit(severity)).alias("severity"), "key", locale.alias("locale"))
    missing = item(sync.missing_keys(refs, catalog, source), "missing-key", F.when(F.col("fallback").isNotNull(), "warn").otherwise("error"))
    unused = item(sync.unused_keys(refs, catalog, source), "unused-key", "warn")
    mismatch = item(sync.placeholder_issues(catalog, source), "placeholder-mismatch", "error", F.col("locale"))
    empty = item(sync.empty_values(refs, catalog, source), "empty-value", "warn", F.col("locale"))
    suspicious = item(sync.suspicious_refs(refs).select("key").distinct(), "suspicious-key", "warn")
    return reduce(DataFrame.unionByName, (missing, unused, mismatch, empty, suspicious))


def severity_counts(items: DataFrame) -> DataFrame:
    """n_error, n_warn, n_info, dominant, exit_code over all items: one row, also for none."""
    counts = items.agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("error", "warn", "info")])
    dominant = F.when(F.col("n_error") > 0, "error").when(F.col("n_warn") > 0, "warn").when(F.col("n_info") > 0, "info").otherwise("none")
    code = F.when(F.col("n_error") > 0, 11).when(F.col("n_warn") > 0, 10).otherwise(0)
    return counts.select("*", dominant.alias("dominant"), code.alias("exit_code"))


def items_by_kind(items: DataFrame) -> DataFrame:
    return items.groupBy("kind", "severity").agg(F.count("*").alias("n_items"), F.countDistinct("key").alias("n_keys"))


def skip_reason_topk(candidates: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent reasons why candidates aren't extracted, ties in order of name."""
    rows = candidates.select(texts.skip_reason(F.col("text")).alias("reason")).where("reason is not null")
    return rows.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def buckets(candidates: DataFrame) -> DataFrame:
    """cand_id, bucket, score of each candidate with a text."""
    bucket, score = texts.confidence(F.col("text"), F.col("skip_reason"), F.col("forced"))
    return candidates.where("text is not null").select("cand_id", bucket.alias("bucket"), score.alias("score"))


def hit_rates(events: DataFrame) -> DataFrame:
    """kind, n_hits, n_misses, hit_rate of cache events (kind, hit)."""
    hits, misses = F.count_if(F.col("hit")), F.count_if(~F.col("hit"))
    return events.groupBy("kind").agg(hits.alias("n_hits"), misses.alias("n_misses"), (hits / F.count("hit")).alias("hit_rate"))


def framework_confidence(evidence: DataFrame) -> DataFrame:
    """framework, confidence, level of weighted evidence (framework, weight)."""
    sums = evidence.groupBy("framework").agg(F.least(F.round(F.sum("weight"), 6), F.lit(1.0)).alias("confidence"))
    level = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "medium").when(F.col("confidence") >= 0.3, "low").otherwise("uncertain")
    return sums.withColumn("level", level)

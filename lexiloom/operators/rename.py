"""Renaming keys: proposals for suspicious ones, what a mapping would do to catalogs and sources, allocating new keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import keys
from lexiloom.functions.whitespace import collapse
from lexiloom.skew import attach


def proposals(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """key, proposed, reason, conflict (existing, repeated or null): one proposal per suspicious key in use.

    Of several keys with one proposal the first in order of key has it, the others are repeated.
    """
    named = refs.select("key").where("key is not null").distinct().withColumn("reason", keys.suspicion(F.col("key"))).where("reason is not null")
    made = named.withColumn("proposed", keys.suggested_fix(F.col("key"), F.col("reason")))
    # The first key of each proposal by aggregation: no window over a proposal that very many keys share.
    first = made.groupBy("proposed").agg(F.min("key").alias("first_key"))
    existing = catalog.select(F.col("key").alias("proposed")).distinct().withColumn("exists", F.lit(True))
    rows = made.join(first, "proposed").join(existing, "proposed", "left")
    conflict = F.when(F.col("exists"), "existing").when(F.col("key") != F.col("first_key"), "repeated")
    return rows.select("key", "proposed", "reason", conflict.alias("conflict"))


def rename_preview(mappings: DataFrame, catalog: DataFrame) -> DataFrame:
    """from_key, to_key, locale, missing, duplicate, for locales that hold either key."""
    old = mappings.join(catalog.select(F.col("key").alias("from_key"), "locale"), "from_key").select("from_key", "to_key", "locale", F.lit(True).alias("has_from"))
    new = mappings.join(catalog.select(F.col("key").alias("to_key"), "locale"), "to_key").select("from_key", "to_key", "locale", F.lit(True).alias("has_to"))
    both = old.join(new, ["from_key", "to_key", "locale"], "full_outer")
    has = lambda c: F.coalesce(c, F.lit(False))
    return both.select("from_key", "to_key", "locale", (~has("has_from")).alias("missing"), (has("has_from") & has("has_to")).alias("duplicate"))


def occurrences(mappings: DataFrame, candidates: DataFrame) -> DataFrame:
    """from_key, n_exact, n_normalised: candidates whose text is the key, exactly or but for white space.

    Texts are counted before the join, so a text that very many candidates share is one row in it.
    """
    texts = candidates.where("text is not null").groupBy("text").agg(F.count("*").alias("n"))
    exact = mappings.join(texts, F.col("from_key") == F.col("text"), "left").select("from_key", F.coalesce("n", F.lit(0)).alias("n_exact"))
    loose = texts.groupBy(collapse(F.col("text")).alias("folded")).agg(F.sum("n").alias("m"))
    return exact.join(loose, collapse(F.col("from_key")) == F.col("folded"), "left").select("from_key", "n_exact", (F.coalesce("m", F.lit(0)) - F.col("n_exact")).alias("n_normalised"))


def prefix_collisions(catalog: DataFrame) -> DataFrame:
    """locale, key, descendants: keys that hold a value and are a dotted prefix of other keys of the locale."""
    above = catalog.select("locale", F.explode(keys.ancestors(F.col("key"))).alias("key")).groupBy("locale", "key").agg(F.count("*").alias("descendants"))
    return catalog.select("locale", "key").join(above, ["locale", "key"])


def renamed(catalog: DataFrame, mappings: DataFrame) -> DataFrame:
    """locale, key, value, outcome after applying a mapping: renamed, duplicate (kept) or unchanged."""
    taken = catalog.select("locale", F.col("key").alias("to_key")).withColumn("taken", F.lit(True))
    rows = catalog.join(mappings.select(F.col("from_key").alias("key"), "to_key"), "key", "left").join(taken, ["locale", "to_key"], "left")
    moves = F.col("to_key").isNotNull() & (F.col("to_key") != F.col("key"))
    outcome = F.when(moves & F.col("taken"), "duplicate").when(moves, "renamed").otherwise("unchanged")
    return rows.select("locale", F.when(outcome == "renamed", F.col("to_key")).otherwise(F.col("key")).alias("key"), "value", outcome.alias("outcome"))


def duplicate_status(candidates: DataFrame) -> DataFrame:
    """cand_id, status, first_id: the first candidate of each text hash is pending, later ones duplicates; keys in use aren't looked up."""
    rows = candidates.where("text_hash is not null")
    first = rows.groupBy("text_hash").agg(F.min("cand_id").alias("first_id"), F.count("*").alias("n"))
    return attach(rows.select("cand_id", "text_hash"), first, ["text_hash"], "cand_id").select("cand_id", F.when(F.col("cand_id") == F.col("first_id"), "pending").otherwise("duplicate").alias("status"), "first_id")


def candidate_dedupe(candidates: DataFrame) -> DataFrame:
    """file_path, line, col_no, cand_id, text: of candidates at one place the last one counts."""
    last = F.max(F.struct("cand_id", "text"))
    return candidates.groupBy("file_path", "line", "col_no").agg(last.alias("last")).select("file_path", "line", "col_no", F.col("last.cand_id").alias("cand_id"), F.col("last.text").alias("text"))


def allocated_hashes(candidates: DataFrame, length: int = 2) -> DataFrame:
    """text, hash: digest prefixes, with suffixes 2, 3, … for other texts of the same prefix in order of their first id.

    The rank inside a prefix is taken over distinct texts; prefixes have a fixed number of hexadecimal digits, and texts
    spread evenly over them, so that no prefix is hot.
    """
    from pyspark.sql.window import Window

    texts = candidates.where("text is not null").groupBy(collapse(F.col("text")).alias("text")).agg(F.min("cand_id").alias("first_id"))
    prefixed = texts.withColumn("prefix", F.substring(F.sha1("text"), 1, length))
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy("first_id"))
    return prefixed.withColumn("rank", rank).select("text", F.when(F.col("rank") == 1, F.col("prefix")).otherwise(F.concat("prefix", F.col("rank").cast("string"))).alias("hash"))

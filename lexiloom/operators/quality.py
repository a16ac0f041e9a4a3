"""Quality of catalogs: duplicate values, orphaned and inconsistent namespaces, the dominant naming convention."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import keys
from lexiloom.functions.whitespace import is_blank, trim_all
from lexiloom.operators.sync import locale_consistency
from lexiloom.skew import attach
from lexiloom.storage import materialize

CONVENTIONS = ("kebab-case", "camelCase", "snake_case")

# Abbreviated prefixes and their full forms.
ABBREVIATIONS = (("btn", "button"), ("msg", "message"), ("err", "error"), ("auth", "authentication"), ("nav", "navigation"), ("cfg", "config"), ("usr", "user"), ("lbl", "label"))


def duplicate_values(catalog: DataFrame, least: int = 3) -> DataFrame:
    """locale, value (as its first key has it), n_keys, first_key for values that several keys of a locale share.

    Values are compared trimmed and in lower case; those shorter than `least` don't count. Counts and the first key are
    pre-aggregated: a value shared by a third of all keys is one row, its keys aren't collected (see `duplicate_members`).
    """
    rows = catalog.where(F.length("value") >= least).withColumn("folded", F.lower(trim_all(F.col("value"))))
    grouped = rows.groupBy("locale", "folded").agg(F.count("*").alias("n_keys"), F.min(F.struct("ord", "value")).alias("first"), F.min("key").alias("first_key"))
    return grouped.where("n_keys > 1").select("locale", F.col("first.value").alias("value"), "n_keys", "first_key")


def duplicate_members(catalog: DataFrame, least: int = 3) -> DataFrame:
    """locale, key, group_key: every key of a duplicate group with the group's first key."""
    rows = catalog.where(F.length("value") >= least).withColumn("folded", F.lower(trim_all(F.col("value"))))
    heads = rows.groupBy("locale", "folded").agg(F.min("key").alias("group_key"), F.count("*").alias("n")).where("n > 1")
    return attach(rows, heads, ["locale", "folded"], "key").select("locale", "key", "group_key")


def distinct_keys(catalog: DataFrame) -> DataFrame:
    return catalog.select("key").distinct()


def orphaned_namespaces(catalog: DataFrame, most: int = 2) -> DataFrame:
    """namespace, n_keys of root namespaces with at most `most` keys."""
    rows = distinct_keys(catalog).select(keys.namespace(F.col("key")).alias("namespace")).where("namespace is not null")
    return rows.groupBy("namespace").agg(F.count("*").alias("n_keys")).where(F.col("n_keys") <= most)


def inconsistent_prefixes(catalog: DataFrame) -> DataFrame:
    """abbreviation, full, n_abbreviated, n_full, suggestion where both forms of a prefix are in use. One pass, one row out of it."""
    root = F.lower(keys.namespace(F.col("key")))
    counts = distinct_keys(catalog).agg(*[F.count_if(root == w).alias(w) for pair in ABBREVIATIONS for w in pair])
    rows = F.array(*[F.struct(F.lit(a).alias("abbreviation"), F.lit(f).alias("full"), F.col(a).alias("n_abbreviated"), F.col(f).alias("n_full")) for a, f in ABBREVIATIONS])
    flat = counts.select(F.explode(rows).alias("r")).select("r.*").where("n_abbreviated > 0 and n_full > 0")
    return flat.withColumn("suggestion", F.when(F.col("n_abbreviated") > F.col("n_full"), F.col("abbreviation")).otherwise(F.col("full")))


def namespace_case_variants(catalog: DataFrame) -> DataFrame:
    """namespace (lower case), variants: namespaces that are spelled in several letter cases."""
    spelled = distinct_keys(catalog).select(keys.namespace(F.col("key")).alias("ns")).where("ns is not null").distinct()
    grouped = spelled.groupBy(F.lower("ns").alias("namespace")).agg(F.array_join(F.array_sort(F.collect_set("ns")), ",").alias("variants"), F.count("*").alias("n"))
    return grouped.where("n > 1").select("namespace", "variants")


def naming_votes(rows: DataFrame, locale_col: str = "locale") -> DataFrame:
    """locale, n_kebab, n_camel, n_snake, n_neutral: separators vote, neutral words don't."""
    part = keys.last_segment(F.col("key"))
    form = F.when(~part.rlike("[a-zA-Z]"), "none").when(part.contains("-"), "kebab").when(part.contains("_"), "snake").when(part.rlike("[a-z][A-Z]"), "camel").otherwise("neutral")
    return rows.withColumn("form", form).groupBy(locale_col).agg(*[F.count_if(F.col("form") == f).alias(f"n_{f}") for f in ("kebab", "camel", "snake", "neutral")])


def _fold(state: tuple[int, int, int], forms) -> tuple[int, int, int]:
    """The votes after the forms in their order: 0 kebab, 1 camel, 2 snake, 3 neutral (which follows the leader)."""
    votes = list(state)
    for f in forms:
        votes[f if f < 3 else votes.index(max(votes))] += 1
    return tuple(votes)


def naming_convention(rows: DataFrame, locale_col: str = "locale", order_col: str = "key") -> DataFrame:
    """locale, convention of each locale's keys, read in their order.

    A separator votes for its form; a neutral word votes for the leader at its place, or for the kebab form as long as
    there is none (equal forms lead in the order kebab, camel, snake). The fold is sequential by definition, yet only counts
    per range of keys are gathered: where the leader's lead exceeds all other votes of a range, no order inside of it can
    change who leads, so its neutral words go to the leader. Only other ranges (the first of each locale, and the rare close
    ones) are replayed, each in its own task of the size of one range.
    """
    part = keys.last_segment(F.col("key"))
    form = F.when(~part.rlike("[a-zA-Z]"), None).when(part.contains("-"), 0).when(part.contains("_"), 2).when(part.rlike("[a-z][A-Z]"), 1).otherwise(3)
    marked = rows.select(F.col(locale_col).alias("loc"), F.col(order_col).alias("ord"), form.alias("form")).where("form is not null")
    ranged = materialize(marked.repartitionByRange("loc", "ord").withColumn("part", F.spark_partition_id()), "naming-ranges")
    counts = ranged.groupBy("loc", "part").agg(*[F.count_if(F.col("form") == f).alias(f"f{f}") for f in range(4)]).collect()
    first: dict[str, int] = {}
    for r in counts:
        first[r["loc"]] = min(r["part"], first.get(r["loc"], r["part"]))

    def replay(start: dict[tuple[str, int], tuple[int, int, int]]) -> dict[tuple[str, int], tuple[int, int, int]]:
        def run(key, pdf):
            v = _fold(start[key[0], int(key[1])], pdf.sort_values("ord")["form"].tolist())
            return pd.DataFrame([[key[0], key[1], *v]], columns=["loc", "part", "k", "c", "s"])

        wanted = F.lit(False)
        for loc, p in start:
            wanted = wanted | ((F.col("loc") == loc) & (F.col("part") == p))
        out = ranged.where(wanted).groupBy("loc", "part").applyInPandas(run, "loc string, part int, k long, c long, s long").collect()
        return {(r["loc"], r["part"]): (r["k"], r["c"], r["s"]) for r in out}

    opened = replay({(loc, p): (0, 0, 0) for loc, p in first.items()}) if first else {}
    done = []
    for loc, p in sorted(first.items()):
        state = opened[loc, p]
        for r in sorted((r for r in counts if r["loc"] == loc and r["part"] > p), key=lambda r: r["part"]):
            lead = state.index(max(state))
            votes = [r["f0"], r["f1"], r["f2"]]
            if max(state) - max(x for i, x in enumerate(state) if i != lead) > sum(votes) - votes[lead]:
                votes[lead] += r["f3"]
                state = tuple(a + b for a, b in zip(state, votes, strict=True))
            else:
                state = replay({(loc, r["part"]): state})[loc, r["part"]]
        done.append((loc, CONVENTIONS[state.index(max(state))]))
    return rows.sparkSession.createDataFrame(done, "locale string, convention string")


def audit_totals(catalog: DataFrame) -> DataFrame:
    """locale, n_keys, n_blank, n_duplicate_groups, n_missing: one row per locale."""
    base = catalog.groupBy("locale").agg(F.count("*").alias("n_keys"), F.count_if(is_blank(F.col("value"))).alias("n_blank"))
    dup = duplicate_values(catalog).groupBy("locale").agg(F.count("*").alias("n_duplicate_groups"))
    gaps = locale_consistency(catalog).select("locale", "n_missing")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return base.join(dup, "locale", "left").join(gaps, "locale", "left").select("locale", "n_keys", "n_blank", zero("n_duplicate_groups"), zero("n_missing"))

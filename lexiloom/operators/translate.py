"""Translation plans: what is to be translated per locale, what a related locale can lend, and writing results back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.functions import placeholders
from lexiloom.functions.whitespace import collapse, is_blank, trim_all
from lexiloom.operators.sync import empty_reason, every_locale, of_locale
from lexiloom.storage import materialize


def is_meaningful(value: Column) -> Column:
    return value.isNotNull() & empty_reason(value).isNull()


def plan(catalog: DataFrame, source: str = "en", forced: bool = False) -> DataFrame:
    """key, locale, source_value, existing, reused_from, reused, n_placeholders of every task.

    Each source key meets each target locale by exploding the one array of locales; target values come by an equi-join, loans from the related locales by `reuse_suggestions`.
    """
    targets = every_locale(catalog.where(F.col("locale") != source))
    wanted = of_locale(catalog, source).where(~is_blank(F.col("value"))).select("key", F.col("value").alias("source_value"), F.explode(targets).alias("locale"))
    have = catalog.select("key", "locale", F.col("value").alias("existing"))
    open_tasks = wanted.join(have, ["key", "locale"], "left")
    if not forced:
        open_tasks = open_tasks.where(~is_meaningful(F.col("existing")))
    lent = reuse_suggestions(catalog)
    return open_tasks.join(lent, ["key", "locale"], "left").select("key", "locale", "source_value", "existing", "reused_from", "reused", F.size(placeholders.extract(F.col("source_value"))).alias("n_placeholders"))


def reuse_suggestions(catalog: DataFrame) -> DataFrame:
    """key, locale, reused_from, reused: for a regional locale the first meaningful value of a sibling region, else of the base.

    Siblings come in order of their code before the base language.
    """
    base = lambda c: F.split_part(c, F.lit("-"), F.lit(1))
    # A key's values are as many as there are locales, so everything happens inside of one row per key: nothing is joined.
    offer = F.struct((F.col("locale") == base(F.col("locale"))).alias("is_base"), F.col("locale").alias("lender"), F.col("value").alias("lent"))
    offers = catalog.where(is_meaningful(F.col("value"))).groupBy("key").agg(F.array_sort(F.collect_list(offer)).alias("offers"))
    regions = every_locale(catalog.where(F.col("locale").contains("-")))
    rows = offers.select("key", "offers", F.explode(regions).alias("locale"))
    first = F.get(F.filter("offers", lambda o: (base(o["lender"]) == base(F.col("locale"))) & (o["lender"] != F.col("locale"))), F.lit(0))
    rows = rows.withColumn("first", first).where("first is not null")
    return rows.select("key", "locale", F.col("first.lender").alias("reused_from"), F.col("first.lent").alias("reused"))


def plan_totals(tasks: DataFrame) -> DataFrame:
    """locale (null: all), n_tasks, n_chars, n_missing, n_existing; locales without tasks don't occur."""
    return tasks.rollup("locale").agg(F.count("*").alias("n_tasks"), F.sum(F.length("source_value")).alias("n_chars"), F.count_if(F.col("existing").isNull()).alias("n_missing"), F.count_if(F.col("existing").isNotNull()).alias("n_existing"))


def chunked(tasks: DataFrame, size: int = 25) -> DataFrame:
    """key, locale, chunk (from 0) of every task: fixed-size batches per locale in order of key, one for all if size isn't positive.

    Numbered without gathering a locale in a task: rows are numbered inside ranges of (locale, key), to which the sum of
    the counts of the ranges before is added. The ranges are written once, so both read the same ones.
    """
    ranged = materialize(tasks.select("locale", "key").repartitionByRange("locale", "key").withColumn("part", F.spark_partition_id()), "chunks")
    counts = ranged.groupBy("locale", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("locale").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("locale", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = ranged.withColumn("n", F.row_number().over(Window.partitionBy("locale", "part").orderBy("key")))
    number = F.col("offset") + F.col("n") - 1
    chunk = F.floor(number / size).cast("long") if size > 0 else F.lit(0).cast("long")
    return numbered.join(offsets, ["locale", "part"]).select("key", "locale", chunk.alias("chunk"))


def exported(tasks: DataFrame, source: str = "en") -> DataFrame:
    """The hand-off rows of a plan."""
    return tasks.select("key", F.lit(source).alias("source_locale"), "source_value", F.col("locale").alias("target_locale"), F.lit("").alias("translated_value"))


def csv_field(c: Column) -> Column:
    return F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_records(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws(",", *[csv_field(F.coalesce(c, F.lit(""))) for c in rows.columns]).alias("record"))


def write_actions(catalog: DataFrame, updates: DataFrame, overwrite: bool = False) -> DataFrame:
    """key, locale, action of each update (key, target_locale, translated_value): skip-empty, skip-existing, unchanged, write.

    Of repeated updates for (key, locale) the greatest value counts; rows without key or locale are left out.
    """
    one = updates.where("key is not null and target_locale is not null").groupBy("key", F.col("target_locale").alias("locale")).agg(F.max("translated_value").alias("new"))
    joined = one.join(catalog.select("key", "locale", "value"), ["key", "locale"], "left")
    action = F.when(is_blank(F.col("new")), "skip-empty").when(F.col("value") == F.col("new"), "unchanged").when(is_meaningful(F.col("value")) & F.lit(not overwrite), "skip-existing").otherwise("write")
    return joined.select("key", "locale", action.alias("action"))


def written(catalog: DataFrame, updates: DataFrame) -> DataFrame:
    """locale, key, value of the catalog after upserting the updates that aren't blank; of repeated ones the greatest counts."""
    one = updates.where("key is not null and target_locale is not null").where(~is_blank(F.col("translated_value")))
    new = one.groupBy(F.col("target_locale").alias("locale"), "key").agg(F.max("translated_value").alias("new"))
    return catalog.select("locale", "key", "value").join(new, ["locale", "key"], "full_outer").select("locale", "key", F.coalesce("new", "value").alias("value"))


def write_totals(actions: DataFrame) -> DataFrame:
    return actions.groupBy("locale").agg(F.count("*").alias("attempted"), F.count_if(F.col("action") == "write").alias("written"), F.count_if(F.col("action") == "skip-empty").alias("empty_skipped"), F.count_if(F.col("action").isin("skip-existing", "unchanged")).alias("skipped"))


def import_checks(rows: DataFrame) -> DataFrame:
    """row_id, missing of hand-off rows whose translation lacks placeholders of its source."""
    gone = placeholders.missing(placeholders.extract(F.col("source_value")), placeholders.extract(F.col("translated_value")))
    return rows.where("source_value is not null and translated_value is not null").withColumn("gone", gone).where(F.size("gone") > 0).select("row_id", F.array_join(F.array_sort("gone"), ",").alias("missing"))


def value_matrix(catalog: DataFrame, length: int = 50) -> DataFrame:
    """key, n_locales, preview: a key's values in all locales, in order of locale, cut to `length` characters each.

    The entries of a key are as many as there are locales.
    """
    cut = F.when(F.length("value") > length, F.concat(F.substring("value", 1, length - 3), F.lit("..."))).otherwise(F.col("value"))
    entry = F.struct("locale", cut.alias("v"))
    grouped = catalog.groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("es"))
    shown = F.transform("es", lambda e: F.concat(e["locale"], F.lit("="), e["v"]))
    return grouped.select("key", F.size("es").alias("n_locales"), F.array_join(shown, " | ").alias("preview"))


def legacy_values(candidates: DataFrame, catalog: DataFrame, source: str = "en") -> DataFrame:
    """cand_id, value, matched (raw, trimmed or collapsed): the value of the source key that a candidate's text names.

    The three forms of a text are tried in this order. Texts are distinct before the join, keys are unique.
    """
    texts = candidates.where("text is not null").select("text").distinct()
    forms = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("form"), c.alias("k")) for i, (n, c) in enumerate((("raw", F.col("text")), ("trimmed", trim_all(F.col("text"))), ("collapsed", collapse(F.col("text")))))])
    tried = texts.select("text", F.explode(forms).alias("f")).select("text", "f.*")
    src = of_locale(catalog, source).select(F.col("key").alias("k"), "value")
    best = tried.join(src, "k").groupBy("text").agg(F.min(F.struct("rank", "form", "value")).alias("b"))
    return candidates.where("text is not null").select("cand_id", "text").join(best, "text").select("cand_id", F.col("b.value").alias("value"), F.col("b.form").alias("matched"))


def normalized_locale(c: Column) -> Column:
    return F.lower(F.replace(trim_all(c), F.lit("_"), F.lit("-")))

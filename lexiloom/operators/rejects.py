"""Loading hand-off records: typed rows for the valid ones, a reason for each of the others.

Every file has its own dialect, told by its header (`line_no` 1): delimiter, columns and their order. Records are
read permissively by `from_csv` under an explicit schema of `MAX_COLUMNS` text columns that keeps the raw text of
what doesn't fit; a record is first padded with as many delimiters as its header lacks to that width, so that it
fits exactly if it has its header's number of fields. Records kept as corrupt and records with quotes that the lenient
reader may have accepted are then reclassified exactly: quoting, count, cast checks, in this order.

The exact layout test splits a record at its double quotes. Pieces at even places lie outside of quotes; the record is
well quoted if their number is odd and each of them is empty (the middle of a doubled quote) or touches its quoted
neighbours with a delimiter only. No regular expression with a loop of groups is used, so texts may have any length.

Defined results
* null or blank `raw`, and headers: neither a row nor a reject.
* a file without a header: comma, and the columns of `DEFAULT_COLUMNS`.
* a header that lacks `key`, `targetLocale` or `translatedValue`: that value is null and isn't checked.
* several records with `line_no` 1: the one with the smallest `line_id` is the header, the others count as headers too.
* repeated records: each is judged on its own. An empty table gives empty results. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.whitespace import is_blank, trim_all
from lexiloom.session import broadcast_if_small

MAX_COLUMNS = 48
SALTS = 16
DELIMITERS = (",", ";", "\t")
DEFAULT_COLUMNS = ("key", "sourcelocale", "sourcevalue", "targetlocale", "translatedvalue")
# Fixed values of the data format.
SPREADSHEET_ERRORS = ("#REF!", "#NAME?", "#VALUE!", "#N/A", "#DIV/0!")
FIELDS = {"key": "key", "source_value": "sourcevalue", "target_locale": "targetlocale", "translated_value": "translatedvalue"}


def _record(raw: Column) -> Column:
    """A record without the one carriage return at its end."""
    return F.when(raw.endswith("\r"), F.expr("substring(raw, 1, length(raw) - 1)")).otherwise(raw)


def _occurrences(text: Column, what: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, what, F.lit("")))


def headers(lines: DataFrame) -> DataFrame:
    """file_name, delimiter, names (normalised, in order): one row per file that has a header."""
    first = lines.where("line_no = 1 and raw is not null").groupBy("file_name").agg(F.min_by("raw", "line_id").alias("raw"))
    bare = F.regexp_replace(_record(F.col("raw")), "^\ufeff", "")
    outside = F.regexp_replace(F.col("bare"), '"[^"]*+"', "q")
    counts = [_occurrences(F.col("outside"), F.lit(d)).alias(f"n{i}") for i, d in enumerate(DELIMITERS)]
    delimiter = F.when((F.col("n2") >= F.col("n1")) & (F.col("n2") >= F.col("n0")) & (F.col("n2") > 0), "\t").when((F.col("n1") >= F.col("n0")) & (F.col("n1") > 0), ";").otherwise(",")
    names = F.transform(_exact_fields(F.col("bare"), F.col("delimiter")), lambda x: F.regexp_replace(F.lower(x), "[^a-z]", ""))
    return (
        first.select("file_name", bare.alias("bare"))
        .select("file_name", "bare", outside.alias("outside"))
        .select("file_name", "bare", *counts)
        .select("file_name", "bare", delimiter.alias("delimiter"))
        .select("file_name", "delimiter", names.alias("names"))
    )


def _pieces(record: Column) -> Column:
    return F.split(record, '"', -1)


def _exact_fields(record: Column, delimiter: Column) -> Column:
    """The fields of a well-quoted record of any width."""
    hidden = "\ufdd0"  # a noncharacter that stands for a delimiter inside quotes; put back below
    inner = F.transform(
        _pieces(record),
        lambda x, i: F.when(i % 2 == 1, F.replace(x, delimiter, F.lit(hidden))).otherwise(x),
    )
    bare = F.split(F.array_join(inner, '"'), F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")), -1)
    unquoted = lambda x: F.when(x.startswith('"') & (F.length(x) > 1), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.transform(bare, lambda x: F.replace(unquoted(x), F.lit(hidden), delimiter))


def _well_quoted(record: Column, delimiter: Column) -> Column:
    parts = _pieces(record)
    last = F.size(parts) - 1
    sound = F.transform(
        parts,
        lambda x, i: (i % 2 == 1) | (x == "") | (((i == 0) | x.startswith(delimiter)) & ((i == last) | x.endswith(delimiter))),
    )
    return (F.size(parts) == 1) | ((F.size(parts) % 2 == 1) & F.forall(sound, lambda x: x))


def _field_count(record: Column, delimiter: Column) -> Column:
    outside = F.filter(_pieces(record), lambda x, i: i % 2 == 0)
    return _occurrences(F.array_join(outside, "q"), delimiter) + 1


def classify(lines: DataFrame, locales: DataFrame) -> DataFrame:
    """line_id, file_name, line_no, key, source_value, target_locale, locale, translated_value, reason.

    `reason` is null for a valid record; `locale` is the known locale it names, in the spelling of `locales`.
    Files are joined with their header on the name and a salt, since one file may hold a third of all records.
    """
    lines = lines.select("line_id", "file_name", "line_no", "raw")
    heads = headers(lines)
    salted = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    body = lines.where((F.coalesce(F.col("line_no"), F.lit(0)) != 1) & ~is_blank(F.col("raw"))).withColumn("salt", F.pmod(F.xxhash64("line_id"), F.lit(SALTS)).cast("int"))
    joined = body.join(salted, ["file_name", "salt"], "left").select(
        "line_id",
        "file_name",
        "line_no",
        _record(F.col("raw")).alias("record"),
        F.coalesce("delimiter", F.lit(",")).alias("delimiter"),
        F.coalesce("names", F.array(*map(F.lit, DEFAULT_COLUMNS))).alias("names"),
    )
    schema = ", ".join(f"c{i} string" for i in range(MAX_COLUMNS)) + ", corrupt string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "quote": '"', "escape": '"', "maxColumns": "20480", "maxCharsPerColumn": "-1"}
    padded = F.concat("record", F.expr(f"repeat(delimiter, greatest(0, {MAX_COLUMNS} - size(names)))"))
    read = F.lit(None)
    for d in DELIMITERS:
        read = F.when(F.col("delimiter") == d, F.from_csv(padded, schema, options | {"delimiter": d})).otherwise(read)
    read_rows = joined.withColumn("read", read)
    plain = ~F.col("record").contains('"')
    suspect = F.col("read.corrupt").isNotNull() | F.col("read").isNull() | (F.size("names") > MAX_COLUMNS)
    columns = F.array(*[F.coalesce(F.col(f"read.c{i}"), F.lit("")) for i in range(MAX_COLUMNS)])
    width = F.size("names")
    judged = read_rows.withColumn(
        "layout",
        F.when(~suspect & plain, F.lit(None).cast("string"))
        .when(~_well_quoted(F.col("record"), F.col("delimiter")), "quoting")
        .when(suspect & (_field_count(F.col("record"), F.col("delimiter")) != width), "column_count"),
    ).withColumn("fields", F.when(F.col("layout").isNull(), F.when(suspect, _exact_fields(F.col("record"), F.col("delimiter"))).otherwise(columns)))
    place = lambda name: F.array_position("names", name)
    value = lambda name: F.when(place(name) > 0, F.get("fields", place(name).cast("int") - 1))
    typed = judged.select("line_id", "file_name", "line_no", "layout", *[value(n).alias(c) for c, n in FIELDS.items()])
    known = locales.where("locale is not null").select(F.lower(F.replace("locale", F.lit("_"), F.lit("-"))).alias("known"), F.col("locale").alias("as_known")).groupBy("known").agg(F.min("as_known").alias("locale"))
    spelled = F.lower(F.replace(trim_all(F.col("target_locale")), F.lit("_"), F.lit("-")))
    with_locale = typed.withColumn("spelled", spelled).join(broadcast_if_small(known), F.col("spelled") == F.col("known"), "left")
    key, text = trim_all(F.col("key")), F.col("translated_value")
    bad_key = (key == "") | key.rlike("[^A-Za-z0-9_.-]") | key.startswith(".") | key.endswith(".") | key.contains("..")
    bad_text = text.rlike(r"[\uFFFD\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]") | trim_all(text).isin(*SPREADSHEET_ERRORS)
    bad_locale = F.col("target_locale").isNotNull() & F.col("locale").isNull()
    invalid = F.coalesce(bad_key, F.lit(False)) | F.coalesce(bad_text, F.lit(False)) | bad_locale
    reason = F.coalesce("layout", F.when(invalid, "invalid_value"))
    return with_locale.select("line_id", "file_name", "line_no", "key", "source_value", "target_locale", "locale", "translated_value", reason.alias("reason"))


def rejected(lines: DataFrame, locales: DataFrame) -> DataFrame:
    """line_id, reason: one row per record that can't be loaded."""
    return classify(lines, locales).where("reason is not null").select("line_id", "reason")


def loaded(lines: DataFrame, locales: DataFrame) -> DataFrame:
    """The valid records as typed rows, keys trimmed and locales in their known spelling."""
    return (
        classify(lines, locales)
        .where("reason is null")
        .select("line_id", "file_name", "line_no", trim_all(F.col("key")).alias("key"), "source_value", F.col("locale").alias("target_locale"), "translated_value")
    )

"""Catalog files: JSON of any depth to rows and back, hand-off CSV files, rename maps, the cache of references."""

from __future__ import annotations

import difflib
import json
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

CATALOG = "locale string, key string, value string, ord long, problem string"
HANDOFF = "key string, sourceLocale string, sourceValue string, targetLocale string, translatedValue string"
CACHE = "file_path string, fingerprint string, key string, line int, col_no int, ord long"


def flatten(node: object, path: tuple[str, ...] = ()) -> Iterator[tuple[str, str | None, str | None]]:
    """(key, value, problem) of every leaf in order. Null is '', an empty object gives nothing, a list is a problem."""
    if isinstance(node, dict):
        for k, v in node.items():
            yield from flatten(v, (*path, k))
    elif isinstance(node, list):
        yield ".".join(path), None, "array"
    elif isinstance(node, bool):
        yield ".".join(path), "true" if node else "false", None
    else:
        yield ".".join(path), "" if node is None else str(node), None


def expand(rows: list[tuple[str, str]]) -> dict:
    """The nested form: empty segments are dropped, of colliding keys the earlier one stays, keys are sorted on every level."""
    root: dict = {}
    for key, value in rows:
        parts = [p for p in key.split(".") if p]
        node = root
        for p in parts[:-1]:
            node = node.setdefault(p, {})
            if not isinstance(node, dict):
                break
        if parts and isinstance(node, dict) and parts[-1] not in node:
            node[parts[-1]] = value

    def ordered(n):
        return {k: ordered(n[k]) for k in sorted(n)} if isinstance(n, dict) else n

    return ordered(root)


def read_catalogs(spark: SparkSession, folder: str) -> DataFrame:
    """locale, key, value, ord, problem of all `*.json` files of a folder; the locale is the file's name.

    Files that don't parse, and lists inside them, come as rows with a problem and no value. A missing folder is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for path, text in zip(b.column("path").to_pylist(), b.column("value").to_pylist()):
                locale = os.path.basename(path).removesuffix(".json")
                try:
                    out += [(locale, k, v, i, p) for i, (k, v, p) in enumerate(flatten(json.loads(text.removeprefix("\ufeff"))))]
                except ValueError:
                    out.append((locale, None, None, 0, "unparsable"))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["locale", "key", "value", "ord", "problem"])

    try:
        files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], CATALOG)
    return files.select(F.col("_metadata.file_path").alias("path"), "value").mapInArrow(run, CATALOG)


def file_insights(rows: DataFrame, expected: list[str]) -> DataFrame:
    """locale, n_keys, n_chars, problem of every catalog read, and of expected locales without a file (problem `missing`)."""
    found = rows.groupBy(F.lower("locale").alias("folded")).agg(F.min("locale").alias("locale"), F.count("value").alias("n_keys"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("n_chars"), F.max("problem").alias("problem"))
    wanted = rows.sparkSession.createDataFrame([(x,) for x in expected], "expected string")
    both = found.join(wanted, F.col("folded") == F.lower("expected"), "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select(F.coalesce("locale", "expected").alias("locale"), zero("n_keys"), zero("n_chars"), F.when(F.col("locale").isNull(), "missing").otherwise(F.col("problem")).alias("problem"))


def yaml_key_count(text: Column) -> Column:
    """Lines of a YAML text that hold a key with a value on the line itself."""
    return F.size(F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"^\s*[\w.\"'-]+\s*:\s+\S") & ~x.rlike(r"^\s*#")))


def catalog_texts(catalog: DataFrame, nested: bool = True) -> DataFrame:
    """locale, text: one JSON document per locale. A locale's document is written as one file and bounded as such."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = list(pdf.sort_values("ord")[["key", "value"]].itertuples(index=False, name=None))
        doc = expand(pairs) if nested else dict(sorted(pairs))
        return pd.DataFrame({"locale": [key[0]], "text": [json.dumps(doc, ensure_ascii=False, indent=2) + "\n"]})

    return catalog.select("locale", "key", "value", "ord").groupBy("locale").applyInPandas(one, "locale string, text string")


def write_catalogs(catalog: DataFrame, folder: str, nested: bool = True) -> None:
    """One `<locale>.json` per locale, keys sorted; written by the executors, a locale's document at a time."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for locale, text in zip(b.column("locale").to_pylist(), b.column("text").to_pylist()):
                with fs.open_output_stream(f"{root}/{locale}.json") as out:
                    out.write(text.encode())
            yield b.select(["locale"])

    from pyarrow import fs as arrow_fs

    fs, root = arrow_fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    catalog_texts(catalog, nested).mapInArrow(store, "locale string").count()


def unified_diffs(before: DataFrame, after: DataFrame) -> DataFrame:
    """locale, patch, n_changed of every locale whose document changed."""
    b = catalog_texts(before, nested=False).withColumnRenamed("text", "old")
    a = catalog_texts(after, nested=False).withColumnRenamed("text", "new")

    @F.pandas_udf("string")
    def patch(locale: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series(["".join(difflib.unified_diff((o or "").splitlines(True), (n or "").splitlines(True), f"a/{x}.json", f"b/{x}.json")) for x, o, n in zip(locale, old, new)])

    joined = b.join(a, "locale", "full_outer").select("locale", patch("locale", "old", "new").alias("patch")).where("patch <> ''")
    lines = F.filter(F.split("patch", "\n"), lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(\+\+\+|---)"))
    return joined.withColumn("n_changed", F.size(lines))


def read_handoff(spark: SparkSession, path: str) -> DataFrame:
    """Hand-off CSV files under their explicit schema; records that don't fit keep their raw text in `corrupt`."""
    return spark.read.schema(HANDOFF + ", corrupt string").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").csv(path)


def write_handoff(rows: DataFrame, path: str) -> None:
    """Rows with key, source_locale, source_value, target_locale, translated_value as CSV with a header."""
    names = {"source_locale": "sourceLocale", "source_value": "sourceValue", "target_locale": "targetLocale", "translated_value": "translatedValue"}
    rows.select("key", *[F.col(a).alias(b) for a, b in names.items()]).write.option("header", True).option("quote", '"').option("escape", '"').mode("errorifexists").csv(path)


def read_rename_map(spark: SparkSession, path: str) -> DataFrame:
    """from_key, to_key of a JSON object, or of lines `"a" = "b"` with `#` comments."""
    text = spark.read.text(path, wholetext=True)
    as_map = F.from_json("value", "map<string,string>")
    objects = text.where(F.trim("value").startswith("{")).select(F.explode(as_map).alias("from_key", "to_key"))
    lines = text.where(~F.trim("value").startswith("{")).select(F.explode(F.split("value", r"\r?\n")).alias("l"))
    pair = r'^\s*"([^"]+)"\s*=\s*"([^"]+)"\s*$'
    return objects.unionByName(lines.where(F.col("l").rlike(pair)).select(F.regexp_extract("l", pair, 1).alias("from_key"), F.regexp_extract("l", pair, 2).alias("to_key")))


def write_cache(refs: DataFrame, fingerprints: DataFrame, path: str) -> None:
    refs.join(fingerprints, "file_path").select("file_path", "fingerprint", "key", "line", "col_no", "ord").write.mode("overwrite").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached references; a missing cache is empty (cold)."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], CACHE)

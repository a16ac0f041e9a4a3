"""The queries of this subpackage, with production parameters over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import codetext, formatdup, labels, lookalikes, mixture, oracles, pairs, spam, tokens
from lexiloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _looks(s: SparkSession, d: str) -> DataFrame:
    return lookalikes.texts(
        {
            "scan_candidates": (table(s, d, "scan_candidates", "cand_id", "text"), "cand_id", "text"),
            "csv_rows": (table(s, d, "csv_rows", "row_id", "translated_value"), "row_id", "translated_value"),
        }
    )


def _records(s: SparkSession, d: str) -> DataFrame:
    rows = formatdup.csv_records(table(s, d, "csv_rows", "row_id", "key", "source_value", "target_locale"))
    return rows.unionByName(formatdup.candidate_records(table(s, d, "scan_candidates", "cand_id", "suggested_key", "text")))


def _fragments(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(s, d, "scan_candidates", "cand_id", "file_path", "kind", "text"), table(s, d, "documents", "doc_id", "lang", "text")


def _imports(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(s, d, "import_rows", "imp_id", "target_locale", "translated_value"), table(s, d, "documents", "doc_id", "lang", "text")


def _mixture(s: SparkSession, d: str) -> mixture.Mixture:
    return mixture.Mixture(table(s, d, "documents", "doc_id", "source", "text"), table(s, d, "source_weights"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: pairs.found(table(s, d, "csv_rows", "row_id", "source_locale", "source_value", "target_locale", "translated_value")),
        "p2_found": lambda s, d: codetext.found(*_fragments(s, d)),
        "p2_shares": lambda s, d: codetext.shares(*_fragments(s, d)),
        "p4_found": lambda s, d: labels.relabelled(*_imports(s, d)),
        "p4_languages": lambda s, d: labels.languages(*_imports(s, d)),
        "p5_found": lambda s, d: lookalikes.same_look(_looks(s, d)),
        "p5_consistent": lambda s, d: lookalikes.consistent(_looks(s, d)),
        "p6_found": lambda s, d: formatdup.copies(_records(s, d)),
        "p6_representatives": lambda s, d: formatdup.representatives(_records(s, d)),
        "p7_ids": lambda s, d: tokens.token_ids(table(s, d, "documents", "doc_id", "text")),
        "p7_roundtrip": lambda s, d: tokens.roundtrip(table(s, d, "documents", "doc_id", "text")),
        "p8_mixture": lambda s, d: _mixture(s, d).drawn,
        "p8_shares": lambda s, d: _mixture(s, d).report(),
        "p9_found": lambda s, d: spam.found(table(s, d, "documents", "doc_id", "text", "lang")),
        "p9_distances": lambda s, d: spam.distances(spam.page_features(table(s, d, "documents", "doc_id", "text", "lang"))),
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()

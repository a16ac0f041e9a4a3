"""Carrying out a translation plan with a translator: batches of fixed size, retries, results in the plan's order.

A translator is a function of (texts, source language, target language) that returns as many texts. It runs where the plan's
rows are, in Arrow batches; the number of partitions bounds how many calls run at once, whatever the size of the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from importlib import import_module
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.texts import ACCENTS

Translator = Callable[[list[str], str, str], list[str]]
_registered: dict[str, Translator] = {}


def register(name: str, translator: Translator) -> None:
    _registered[name] = translator


def load(name: str) -> Translator:
    """A registered translator, or `module:function` (without a function the module's `translate`)."""
    if name in _registered:
        return _registered[name]
    module, _, attribute = name.partition(":")
    found = getattr(import_module(module), attribute or "translate", None)
    if not callable(found):
        raise ValueError(f"{name} is no translator")
    return found


def pseudo(texts: list[str], source: str, target: str) -> list[str]:
    """Marks a text with its language and puts accents on its vowels."""
    table = str.maketrans(*ACCENTS)
    return [f"[{target}] {t.translate(table)}" for t in texts]


register("pseudo", pseudo)


def _called(translator: Translator, texts: list[str], source: str, target: str, tries: int) -> tuple[list[str | None], str | None]:
    """The translations, or nulls and the last error after `tries` calls. A wrong number of texts is an error."""
    error = None
    for _ in range(tries):
        try:
            out = translator(texts, source, target)
            if len(out) == len(texts):
                return list(out), None
            error = f"{len(out)} texts for {len(texts)}"
        except Exception as e:  # a translator's own failure concerns its batch alone
            error = f"{type(e).__name__}: {e}"
    return [None] * len(texts), error


def executed(tasks: DataFrame, translator: Translator, *, source: str = "en", batch: int = 25, tries: int = 3, at_once: int | None = None) -> DataFrame:
    """key, locale, translated, error of every task of a plan (key, locale, source_value).

    Null sources aren't sent and stay null. With `at_once` the tasks are spread over so many partitions, otherwise each
    stays where it is. Rows are independent; a lost executor's batches are translated again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, locales, values = (b.column(c).to_pylist() for c in ("key", "locale", "source_value"))
            out: list[str | None] = [None] * len(keys)
            errors: list[str | None] = [None] * len(keys)
            order = sorted((i for i, v in enumerate(values) if v is not None and locales[i] is not None), key=lambda i: locales[i])
            for locale, rows in groupby(order, key=lambda i: locales[i]):
                rows = list(rows)
                for at in range(0, len(rows), batch):
                    own = rows[at : at + batch]
                    got, error = _called(translator, [values[i] for i in own], source, locale, tries)
                    for i, t in zip(own, got, strict=True):
                        out[i], errors[i] = t, error
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("locale"), pa.array(out, pa.string()), pa.array(errors, pa.string())], names=["key", "locale", "translated", "error"])

    kept = tasks.select("key", "locale", "source_value")
    kept = kept.repartition(at_once) if at_once else kept
    return kept.mapInArrow(run, "key string, locale string, translated string, error string")


def results(done: DataFrame) -> DataFrame:
    """locale, n_translated, n_failed, errors (distinct ones, in order) by locale."""
    return done.groupBy("locale").agg(F.count("translated").alias("n_translated"), F.count("error").alias("n_failed"), F.array_join(F.array_sort(F.slice(F.array_sort(F.collect_set("error")), 1, 5)), "; ").alias("errors"))

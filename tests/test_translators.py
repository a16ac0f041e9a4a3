"""Translators with batches and retries; backups of catalogs."""

import datetime

import pytest

from lexiloom.operators import translators
from lexiloom.sources import backups
from lexiloom.storage import run_folder


def test_batches_retries_and_errors(spark):
    rows = [("a", "de", "Hello"), ("b", "de", None), ("c", "fr", "Bye"), ("d", None, "x"), ("e", "xx", "Fail"), ("a", "de", "Hello")]
    tasks = spark.createDataFrame([(*r, 1) for r in rows], "key string, locale string, source_value string, n int")

    def flaky(texts, source, target):
        if target == "xx":
            raise OSError("closed")
        return [f"{target}:{t}" for t in texts]

    got = translators.executed(tasks, flaky, batch=1, at_once=2)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", "de", "de:Hello", None), ("a", "de", "de:Hello", None), ("b", "de", None, None), ("c", "fr", "fr:Bye", None), ("d", None, None, None), ("e", "xx", None, "OSError: closed")], key=str)
    assert {(r.locale, r.n_translated, r.n_failed) for r in translators.results(got).collect()} == {("de", 2, 0), ("fr", 1, 0), (None, 0, 0), ("xx", 0, 1)}
    assert translators.executed(tasks.where("false"), flaky).collect() == []
    calls = []

    def second(texts, source, target):
        calls.append(len(texts))
        return texts if len(calls) > 1 else []

    assert translators._called(second, ["x"], "en", "de", 3) == (["x"], None) and len(calls) == 2
    assert translators.load("pseudo")(["aU"], "en", "de") == ["[de] áÚ"] and translators.load("lexiloom.operators.translators:pseudo") is translators.pseudo
    with pytest.raises(ValueError):
        translators.load("lexiloom.operators.translators:nothing")


def test_backups(spark):
    folder = f"{run_folder(spark)}/backups"
    assert backups.listed(spark, folder).collect() == []
    with pytest.raises(ValueError):
        backups.restored(spark, folder)
    names = []
    for k in range(4):
        cat = spark.createDataFrame([("en", f"k{i}", "v", i) for i in range(k)], "locale string, key string, value string, ord long")
        names.append(backups.create(cat, folder, f"run {k}", datetime.datetime(2024, 1, 1, 0, 0, k)))
    assert names[0] is None and [r.name for r in backups.listed(spark, folder).collect()] == names[:0:-1]
    assert backups.restored(spark, folder).count() == 3 and backups.restored(spark, folder, names[1]).count() == 1
    assert backups.prune(spark, folder, 2) == [names[1]] and [r.n_keys for r in backups.listed(spark, folder).collect()] == [3, 2]

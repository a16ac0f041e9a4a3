"""Batches of translation tasks."""

from lexiloom.operators import translate


def test_every_task_has_its_chunk(spark):
    keys = {"de": [f"k{i:04}" for i in range(260)], "fr": [f"k{i:04}" for i in range(25)], "ja": ["only"]}
    tasks = spark.createDataFrame([(k, lo) for lo, ks in keys.items() for k in reversed(ks)], "key string, locale string").repartition(7)
    want = sorted((k, lo, i // 25) for lo, ks in keys.items() for i, k in enumerate(ks))
    assert sorted(tuple(r) for r in translate.chunked(tasks).collect()) == want
    assert {r.chunk for r in translate.chunked(tasks, 0).collect()} == {0}

import os

import pytest

from lexiloom import storage


class _Elsewhere:
    """A session whose master isn't local and that names no shared folder."""

    class conf:
        get = staticmethod(lambda *_: None)

    class sparkContext:
        master = "spark://host:7077"
        getConf = staticmethod(dict)


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        storage.shared_folder(_Elsewhere)


def test_tables_are_deleted(spark):
    df = storage.materialize(spark.range(3), "x")
    folder = storage.run_folder(spark).removeprefix("file://")
    assert df.count() == 3 and os.listdir(folder)
    storage.release(spark)
    assert not os.path.exists(folder)
    assert storage.materialize(spark.range(2), "x").count() == 2


def test_broadcasts_are_checked_by_rows_and_bytes(spark):
    from lexiloom.session import broadcast_if_small

    df = spark.createDataFrame([(i, "é" * 50, [i] * 3) for i in range(20)], "id long, text string, list array<int>")
    marked = lambda d: "hint" in d._jdf.queryExecution().logical().toString().lower()
    assert marked(broadcast_if_small(df)) and not marked(broadcast_if_small(df, limit=19)) and not marked(broadcast_if_small(df, most=2000))
    assert marked(broadcast_if_small(df.where("false")))

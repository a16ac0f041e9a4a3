import datetime as dt

from lexiloom.streaming import changes

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_debounce_batch_and_stream(spark, tmp_path):
    rows = [("src", at(m)) for m in (0, 5, 14, 40, 41)] + [("locale", at(3)), ("src", at(5000))]
    df = spark.createDataFrame(rows, "trigger string, ts timestamp")
    batch = {(r.trigger, r.started, r.n_events) for r in changes.debounced(df).collect()}
    assert batch == {("src", at(0), 3), ("src", at(40), 2), ("locale", at(3), 1), ("src", at(5000), 1)}
    df.write.parquet(str(tmp_path / "in"))
    stream = changes.debounced_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), late="1 minute")
    q = stream.writeStream.outputMode("append").format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    fired = {(r.trigger, r.started, r.n_events) for r in spark.table("fired").collect()}
    assert fired == batch - {("src", at(5000), 1)}


def test_breaker_batch_and_stream(spark, tmp_path):
    flags = [1, 1, 0, 1, 1, 1, 1, 0, 1]
    rows = [("w", at(i), i, bool(f)) for i, f in enumerate(flags)] + [("v", at(0), 0, True)]
    df = spark.createDataFrame(rows, "stream string, ts timestamp, ord long, failed boolean")
    assert {tuple(r) for r in changes.breaker(df).collect()} == {("w", 1), ("v", 0)}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = changes.breaker_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("states").collect()} == {("w", False, 1), ("v", False, 1)}


def test_incremental(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file_path string, fingerprint string")
    old = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "file_path string, fingerprint string")
    assert {tuple(r) for r in changes.incremental(new, old).collect()} == {("a", "reuse"), ("b", "parse"), ("c", "parse"), ("d", "drop")}
    assert {r.action for r in changes.incremental(new, old, header_matches=False).collect()} == {"parse", "drop"}


def test_refreshed_equals_cold(spark):
    from pyspark.sql import functions as F

    from lexiloom.streaming import changes

    old = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "b", "y"), (4, "gone", "z")], "cand_id long, file_path string, text string")
    new = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "b", "changed"), (5, "new", "w")], old.schema)
    seen = []
    extract = lambda df: seen.append(df) or df.select("file_path", "cand_id", F.upper("text").alias("u"))
    got = changes.refreshed(new, extract(old), changes.text_fingerprints(old), extract)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, new.select("file_path", "cand_id", F.upper("text")).collect()), key=str)
    assert {r.file_path for r in seen[-1].collect()} == {"b", "new"}
    assert changes.refreshed(new.where("false"), extract(old), changes.text_fingerprints(old), extract).collect() == []

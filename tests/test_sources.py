import json

from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.sources import catalog_files as cf

name = st.text("abcxyz", min_size=1, max_size=4)
tree = st.recursive(st.text(max_size=5), lambda c: st.dictionaries(name, c, min_size=1, max_size=4), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(name, tree, max_size=4))
def test_expand_undoes_flatten(doc):
    assert cf.expand([(k, v) for k, v, _ in cf.flatten(doc)]) == doc


def test_flatten_shapes():
    assert list(cf.flatten({"a": {"b": 1, "c": None, "d": True, "e": {}}, "f": [1]})) == [("a.b", "1", None), ("a.c", "", None), ("a.d", "true", None), ("f", None, "array")]


def test_files(spark, tmp_path):
    (tmp_path / "en.json").write_text(json.dumps({"a": {"b": "x"}, "c": "y"}))
    (tmp_path / "de.json").write_text("{broken")
    got = sorted(tuple(r) for r in cf.read_catalogs(spark, str(tmp_path)).select("locale", "key", "value", "problem").collect() if r)
    assert got[1:] == [("en", "a.b", "x", None), ("en", "c", "y", None)] and got[0] == ("de", None, None, "unparsable")
    assert cf.read_catalogs(spark, str(tmp_path / "none")).count() == 0
    good = cf.read_catalogs(spark, str(tmp_path)).where("problem is null")
    assert json.loads(cf.catalog_texts(good).collect()[0].text) == {"a": {"b": "x"}, "c": "y"}
    d = cf.unified_diffs(good, good.where("key <> 'c'")).collect()[0]
    assert d.n_changed >= 1 and '-  "c": "y"' in d.patch


def test_handoff_round_trip(spark, tmp_path):
    rows = [("a.b", "en", 'He said "x", y', "de", "line\nbreak"), ("c", "en", "", "fr", "é")]
    df = spark.createDataFrame(rows, "key string, source_locale string, source_value string, target_locale string, translated_value string")
    cf.write_handoff(df, str(tmp_path / "out"))
    back = cf.read_handoff(spark, str(tmp_path / "out"))
    assert {(r.key, r.sourceValue, r.translatedValue) for r in back.collect()} == {("a.b", rows[0][2], rows[0][4]), ("c", None, "é")}


def test_rename_maps(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": "b"}')
    (tmp_path / "m.txt").write_text('# note\n"c" = "d"\n')
    assert {tuple(r) for r in cf.read_rename_map(spark, str(tmp_path)).collect()} == {("a", "b"), ("c", "d")}


def test_cache(spark, tmp_path):
    assert cf.read_cache(spark, str(tmp_path / "none")).count() == 0
    refs = spark.createDataFrame([("k", "f", 1, 2, 3)], "key string, file_path string, line int, col_no int, ord long")
    prints = spark.createDataFrame([("f", "1:2")], "file_path string, fingerprint string")
    cf.write_cache(refs, prints, str(tmp_path / "c"))
    assert cf.read_cache(spark, str(tmp_path / "c")).collect()[0].fingerprint == "1:2"


def test_insights(spark):
    rows = spark.createDataFrame([("en", "a", "xy", 0, None), ("en", "b", None, 1, "array"), ("de", None, None, 0, "unparsable")], cf.CATALOG)
    got = {tuple(r) for r in cf.file_insights(rows, ["EN", "fr"]).collect()}
    assert got == {("en", 1, 2, "array"), ("de", 0, 0, "unparsable"), ("fr", 0, 0, "missing")}
    text = spark.createDataFrame([("a: 1\nb:\n  c: x\n# d: y\n",)], "t string")
    assert text.select(cf.yaml_key_count(text["t"])).collect()[0][0] == 2

"""Reports on findings and catalogs on small fixtures."""

from lexiloom.operators import extract, report
from lexiloom.sources import catalog_files
from lexiloom.storage import run_folder
from pyspark.sql import functions as F

ITEMS = "kind string, severity string, key string, locale string"
CATALOG = "locale string, key string, value string, ord long"


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEMS)


def test_exit_codes(spark):
    one = lambda *kinds: report.strict_exit(items(spark, *[(k, "warn", "a", None) for k in kinds])).first()[0]
    assert (one("unused-key"), one("empty-value", "missing-key"), one("empty-value", "placeholder-mismatch"), one("placeholder-mismatch", "suspicious-key"), one()) == (1, 3, 2, 4, 0)


def test_health_and_copies(spark):
    df = items(spark, ("missing-key", "error", "a", None), ("missing-key", "info", "a", None), ("empty-value", "warn", None, "de"))
    assert tuple(report.health(df).first()) == (True, False, 3, 1, "1 critical, 1 warning, 1 info")
    assert {tuple(r) for r in report.unique_items(df).collect()} == {("missing-key", "a", None, "error", 2), ("empty-value", None, "de", "warn", 1)}
    assert tuple(report.health(df.where("false")).first()) == (False, False, 0, 0, "") and report.drift_stats(df.where("false")).collect() == []
    assert [r.severity for r in report.ordered_items(df, 2).collect()] == ["error", "warn"]


def test_collisions_are_moved(spark):
    cat = spark.createDataFrame([("en", "a.b", "x", 1), ("en", "c.d.e", "x", 2), ("en", "f", "x", 3), ("en", "f.g_h", "x", 4)], CATALOG)
    rows = spark.createDataFrame([("a.b.c",), ("c.d",), ("free.key",), ("f.x",), ("c",), (None,), ("c.d",)], "key string")
    got = {r.key: (r.made, r.status) for r in report.resolved_keys(rows, cat).collect()}
    assert got == {"a.b.c": ("a.b_c", "moved"), "c.d": ("c.d_text", "moved"), "free.key": ("free.key", "free"), "f.x": ("f_x", "moved"), "c": ("c_text", "moved")}


def test_coverage_and_locales(spark):
    cat = spark.createDataFrame([("en", "a", "x", 1), ("en", "b", " ", 2), ("en", "c", "z", 3), ("de", "a", "y", 4), ("de", "b", "y", 5), ("fr", "q", "", 6)], CATALOG)
    assert {tuple(r) for r in report.coverage(cat).collect()} == {("de", 2, 1, 0.5), ("fr", 2, 0, 0.0)}
    assert {r.locale for r in report.requested_locales(cat, ["fr", "xx"]).collect()} == {"fr"} and {r.locale for r in report.requested_locales(cat, ["xx"]).collect()} == {"de", "fr"}
    assert {tuple(r) for r in report.equal_catalogs(cat, cat.where("locale <> 'fr'")).collect()} == {("en", True), ("de", True), ("fr", False)}
    assert report.shape_guess(cat, 2).first().shape == "auto" and report.coverage(cat.where("false")).collect() == []
    assert {(r.key, r.kept) for r in report.newest(cat.where("locale = 'en'"), "ord", 2).collect()} == {("a", False), ("b", True), ("c", True)}


def test_advice_on_patterns(spark):
    m = spark.createDataFrame([("src/*.x", "include", 0), ("/lib\\a", "include", 2), ("q/**", "include", 0), ("z", "exclude", 9)], "pattern string, side string, n_files long")
    assert {tuple(r) for r in report.pattern_advice(m).collect()} == {("src/*.x", "check-source-folder"), ("/lib\\a", "leading-slash"), ("/lib\\a", "backslash"), ("q/**", "recurse-with-slashes"), ("*", "excludes-too-broad")}


def test_documents_of_many_lines_are_read_whole(spark):
    cat = spark.createDataFrame([("en", "a.b", "x\ny", 1), ("en", "a.c", "", 2), ("pt-BR", "d", 'q"', 3)], CATALOG)
    for nested in (True, False):
        folder = f"{run_folder(spark)}/documents-{nested}"
        catalog_files.write_catalogs(cat, folder, nested=nested)
        back = catalog_files.read_catalogs(spark, folder)
        assert sorted((r.locale, r.key, r.value, r.problem) for r in back.collect()) == [("en", "a.b", "x\ny", None), ("en", "a.c", "", None), ("pt-BR", "d", 'q"', None)]


def test_mustaches_by_line(spark):
    df = spark.createDataFrame([(1, "}} {{"), (2, "a {{ b }}\n}}\n{{ c"), (3, "{{ a }}"), (4, None), (5, "{{\n}}"), (6, "x")], "doc_id int, text string")
    assert {tuple(r) for r in extract.template_syntax_issues(df).collect()} == {(2, 2, 2, 2, 1)}
    df = spark.createDataFrame([(1, "}}\n{{")], "doc_id int, text string")
    assert tuple(extract.template_syntax_issues(df).first()) == (1, 1, 1, 1, 1)


def test_bound_attributes(spark):
    df = spark.createDataFrame([(1, """<a :title="ok ? 'Yes' : 'No'" v-bind:alt="`Hi ${n}`" label={'Go'} x="y">"""), (2, None)], "cand_id int, text string")
    assert {(r.attribute, r.literal) for r in extract.bound_attributes(df).collect()} == {("title", "Yes"), ("title", "No"), ("alt", "Hi"), ("label", "Go")}
    names = spark.createDataFrame([(i, e) for i, e in enumerate(["x", "a.b", "items[0]", "list[1]", "f()", None])], "i int, e string")
    assert [r.n for r in names.select("i", extract.variable_name(F.col("e"), 2).alias("n")).orderBy("i").collect()] == ["x", "b", "item", "listItem", "var3", None]

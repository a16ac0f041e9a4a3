from pyspark.sql import functions as F

from lexiloom.functions import expressions as ex
from lexiloom.operators import extract, project


def values(spark, f, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_expressions(spark):
    assert values(spark, ex.is_translatable_attribute, ["class", "ALT", "helpText", "submit-label", "data-x", None]) == [False, True, True, True, False, None]
    assert values(spark, ex.without_openers, ["Items ({count})", "a [ {b}  c"]) == ["Items {count})", "a {b} c"]
    assert values(spark, ex.assumption, ["`a.${x}..b`", "'k' || y", None]) == ["a.*.b", "k", None]
    assert values(spark, ex.format_placeholder, ["n", None]) == ["{{n}}", None]
    assert values(spark, lambda c: ex.is_component(F.lit("a.bc.d"), c), ["bc", "b", "a.bc", "a.bc.d", "d"]) == [True, False, True, False, True]
    assert values(spark, ex.preview, ["x" * 51, "y"]) == ["x" * 47 + "...", "y"]
    assert values(spark, extract.expression_class, ["'a' + b", "'a'", "`a ${b}`", "a ? 'b' : 'c'", "a || b", "a", None]) == ["concat", "literal", "template", "conditional", "logical", "dynamic", None]
    assert values(spark, extract.parameter_name, ["user.name", "getName()", "a + b", "x"]) == ["name", "arg0", "arg0", "x"]


def test_files(spark):
    files = spark.createDataFrame([("src/a/b.tsx", "t('x'); useThing();"), ("src/legacy/c.tsx", None), ("lib/d.ts", "$t('y')"), ("src/a/b.tsx", "")], "file_path string, text string")
    got = {r.file_path for r in project.matched_files(files, ["src/**/*.tsx"], ["src/legacy/**"]).collect()}
    assert got == {"src/a/b.tsx"}
    assert {tuple(r) for r in project.pattern_matches(files, ["src/**"], ["*.js"]).collect()} == {("src/**", "include", 2), ("*.js", "exclude", 0)}
    assert {(r["call"], r.n_matches) for r in project.translation_usage(files).collect()} == {("t", 1), ("hook", 1)}
    assert {(r.extension, r.n_files) for r in project.extensions(files).collect()} == {("tsx", 2), ("ts", 1)}


def test_packages_and_cache(spark):
    m = spark.createDataFrame([("p", '{"dependencies": {"a": "1"}, "devDependencies": {"a": "2", "b": "3"}}'), ("q", "broken"), ("r", None)], "path string, text string")
    assert {tuple(r) for r in project.dependencies(m).collect()} == {("p", "a", "1", "dependencies"), ("p", "b", "3", "devDependencies")}
    headers = spark.createDataFrame([("x", "1", "c", None, "s"), ("x", "2", "d", "t", "s")], "identifier string, version string, config_hash string, tool_version string, parser_signature string")
    now = {"version": "1", "identifier": "x", "config_hash": "c", "tool_version": "t", "parser_signature": "s"}
    assert sorted(r.reasons for r in project.invalidation_reasons(headers, now).collect()) == ["", "version,config"]
    c = spark.createDataFrame([("de", "a"), ("de", "b"), ("fr", "a")], "locale string, key string")
    assert project.source_language(c).collect()[0].locale == "de" and project.source_language(c.where("false")).collect() == []

"""Rules on texts and expressions against cases worked out by hand."""

from pyspark.sql import functions as F

from lexiloom.functions import expressions, keys, texts
from lexiloom.operators import extract, sync


def values(spark, f, *cases):
    rows = spark.createDataFrame([(i, *c) if isinstance(c, tuple) else (i, c) for i, c in enumerate(cases)], "i int, a string, b string" if isinstance(cases[0], tuple) else "i int, a string")
    return [r.v for r in rows.select("i", f.alias("v")).orderBy("i").collect()]


def test_queries_are_cut_at_the_match(spark):
    cases = ["FROMAGE FROM x", "Rename: SELECT * FROM t", "Select the travel dates", "select = 'x'", "Plain", "", None, "A  \n UPDATE t", "Übersicht ORDER  BY x"]
    assert values(spark, texts.before_query(F.col("a")), *cases) == ["FROMAGE", "Rename:", "Select the travel dates", "", "Plain", "", None, "A", "Übersicht"]


def test_expression_and_template_reasons(spark):
    cases = ['{"a": 1}', "please select from the list", "%s %d", "+1 (555) 123-4567", "/a+b/gi", "t('a')", "Hello", "[1, 2]", "if you return", "https://x", None]
    assert values(spark, expressions.expression_reason(F.col("a")), *cases) == ["json-like-string", "sql-like-string", "format-specifiers", "phone-number", "regex-pattern", "i18n-call-pattern", None, None, None, None, None]
    assert values(spark, expressions.template_reason(F.col("a")), *cases) == ["json-like-content", None, None, None, None, None, None, "json-like-content", "code-like-content", "url-template", None]


def test_attribute_context(spark):
    cases = [("Submit form", None), ("Some words", "className"), ("submit", "type"), ("M 0 0 thing", "d"), ("Read more", "href"), ("home:icon", "icon"), ("Start here", "title"), ("", "title")]
    assert values(spark, texts.skip_reason(F.col("a"), attribute=F.col("b")), *cases) == [None, "non_sentence", "html-type-keyword", "non_sentence", None, "non_sentence", None, "empty"]
    assert values(spark, texts.skip_reason(F.col("a"), deny=("^DRAFT", "(")), "draft of it", "A draft") == ["deny-pattern", None]


def test_pattern_sets():
    names = lambda **k: [p[0] for p in texts.pattern_set(**k)]
    assert names(enabled=("url", "uuid"), disabled=("uuid",)) == ["url"] and "sql" not in names(skipped_categories=("code",))
    assert names(enabled=(), custom=(("ticket", "x", 0.9, r"^T-\d+$"), ("bad", "x", 0.9, "("))) == ["ticket"]


def test_hash_of_units_beyond_the_basic_plane(spark):
    def plain(text):
        h, raw = 0, text.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h * 31 + int.from_bytes(raw[i : i + 2], "big")) & 0xFFFFFFFF
        n, out = (2**32 - h if h >= 2**31 else h), ""
        while n or not out:
            n, d = divmod(n, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        return out

    cases = ["a", "", "😀 ok", "Grüße 🇪🇺", "日本"]
    assert values(spark, keys.text_hash(F.col("a")), *cases) == [plain(c) for c in cases]


def test_patterns_without_values_give_nothing(spark):
    df = spark.createDataFrame([("a.*", ["x", "y"]), ("b.c", []), ("d.e", ["z", "w"]), ("*.f.*", ["g"])], "pattern string, values array<string>")
    assert {tuple(r) for r in sync.expanded_keys(df).collect()} == {("a.*", "a.x"), ("a.*", "a.y"), ("d.e", "d.e"), ("*.f.*", "g.f.g")}


def test_concatenations(spark):
    lines = ["'Items (' + count + ') of ' + user.name", "a + b", "'a + b'", "`x ${y}` + 'z'", "'one ' + 'two'", "call(1) + ' left' + o.m(2)", "x++"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*lines, None, ""])], "cand_id int, text string")
    got = {r.cand_id: (r.shape, r["class"], r.merged) for r in extract.concatenations(df).collect()}
    assert got == {
        0: ("interleaved", "mixed", "Items {{count}}) of {{name}}"),
        1: ("dynamic-prefix", "pure-dynamic", None),
        3: ("dynamic-prefix", "mixed", "{{arg0}}z"),
        4: ("static-prefix", "static", "one two"),
        5: ("interleaved", "mixed", "{{arg0}} left{{m}}"),
        6: ("dynamic-prefix", "pure-dynamic", None),
    }

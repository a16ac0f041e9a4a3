import pytest
from pyspark.sql import functions as F

from lexiloom.functions import globs, keys, placeholders, texts


def values(spark, f, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_suspicion(spark):
    cases = {"Found": "single-word-no-namespace", "Save now": "contains-spaces", "a.Warning!": "trailing-punctuation", "nav.TheTitle": "sentence-article", "common.TheQuickBrownFoxJumps": "pascal-case-sentence", "common.title": None, "common.item-list": None, None: None, "": None}
    assert values(spark, keys.suspicion, list(cases)) == list(cases.values())


def test_equal_to_value(spark):
    rows = spark.createDataFrame([("submit", "Submit"), ("common.submit", "Submit"), ("save-all", "Save all!"), ("x", None)], "k string, v string")
    got = [r.r for r in rows.select(keys.suspicion_with_value(F.col("k"), F.col("v")).alias("r")).collect()]
    assert got == ["key-equals-value", None, "key-equals-value", "single-word-no-namespace"]


def test_normalised(spark):
    cases = {"Save The Report Now Please": "common.save-the-report-now", "auth.LoginButton": "auth.login-button", "HTMLParser": "common.html-parser", "?!": "common.unknown", "a b.c": "common.a-b-c"}
    assert values(spark, keys.normalized_key, list(cases)) == list(cases.values())
    assert values(spark, lambda c: keys.normalized_key(c, "camelCase"), ["auth.save the report"]) == ["auth.saveTheReport"]
    assert values(spark, lambda c: keys.normalized_key(c, "snake_case"), ["auth.save the report"]) == ["auth.save_the_report"]
    assert values(spark, lambda c: keys.normalized_key(c, preserve=True), ["auth.saveReport"]) == ["auth.saveReport"]


def test_values_from_keys(spark):
    cases = {"common.CTASecondary": "CTA Secondary", "a.save_report.1a2b3c": "Save Report", "1a2b.3c4d": "3c4d", "x.delete-delete_all": "Delete All", "": ""}
    assert values(spark, keys.value_from_key, list(cases)) == list(cases.values())


def rolling(text):
    h = 0
    for c in text:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    h = abs(h - (1 << 32) if h >= 1 << 31 else h)
    digits = ""
    while h:
        h, r = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
    return digits or "0"


def test_text_hash(spark):
    inputs = ["", "a", "Hello world", "x" * 500, "Ünïcödé", "日本語"]
    assert values(spark, keys.text_hash, inputs) == [rolling(x) for x in inputs]


def test_generated(spark):
    assert values(spark, keys.generated_key, ["Items (", ") remaining", "Save & Close!", None]) == ["items", "remaining", "save_close", None]
    assert values(spark, lambda c: keys.generated_key(c, "camel"), ["Save the report", "x-y"]) == ["saveTheReport", "xY"]


def test_placeholders(spark):
    got = values(spark, placeholders.extract, ["Hi {{ name }} %s %s %{n} {{name}}", "none", ""])
    assert [list(x) for x in got] == [["name", "n", "__positional__1", "__positional__2"], [], []]


def test_globs(spark):
    def hits(regex, *inputs):
        return values(spark, lambda c: c.rlike(regex), inputs)

    assert hits(globs.key_regex("a.*.c"), "a.b.c", "a.b.x.c", "a.b.c\n") == [True, False, False]
    assert hits(globs.key_regex("a.**"), "a.b.c", "b.a") == [True, False] and hits(globs.key_regex("?.b"), "a.b") == [True]
    assert hits(globs.path_regex("src/**/*.{ts,tsx}"), "src/a/b.tsx", "src/b.ts", "lib/b.ts") == [True, True, False]


@pytest.mark.parametrize(
    "text,reason",
    [(None, "empty"), ("", "empty"), ("x", "single-character"), ("&nbsp;", "html-entity"), ("https://a.example", "non_sentence"), ("flex items-center gap-2", "non_sentence"), ("SOME_CONST", "non_sentence"), ("***", "repeated-symbols"), ("center", "css-value-keyword"), ("deu", "locale-code"), ("?! 12)", "no-letters"), ("Save the report", None), ("Über uns", None)],
)
def test_filter(spark, text, reason):
    assert values(spark, texts.skip_reason, [text]) == [reason]


def test_patterns_and_decoding(spark):
    got = values(spark, lambda c: texts.detected_pattern(c)["name"], ['{"a": 1}', "a@b.org", "1.2.3", "Plain text", "t('x')"])
    assert got == ["json-object", "email", "version", None, "i18n-call"]
    assert values(spark, texts.decoded, ["&lt;b&gt; &#65;&#x1F600;&amp;lt;", None, "&#xD800;"]) == ["<b> A\U0001f600<", None, "&#xD800;"]

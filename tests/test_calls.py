"""The lexer of calls: what counts as a call, which keys are dynamic and why, and where calls stand."""

from lexiloom.functions import config
from lexiloom.operators import calls
from pyspark.sql import functions as F

T = frozenset(["t"])
SOURCE = """const a = t('a.b'); // t('no')
x.t('m'); t(`k`); t(`k.${id}.x`) ; t('p.' + q) ; t(cond ? 'a' : 'b'); t(fn('z', 1), 2); t(); i18n['t']('br');
`${t('in.hole')} ${`n ${t("deep")}`}` ; function t(q) {} ; t("it's \\u00e9") ; t(a, b); t(-x); t(x => x + 1); xt('no'); "t('no')"
<p title={t('attr')}>It's {t('jsx')}</p> /* t('no') */ t(a || 'b'); t(typeof a === 'x'); t(`a` + `b`); t({k: 'x'}); t('open'"""


def test_kinds():
    got = [(what, key or expression) for _, _, what, key, expression in calls.calls(SOURCE, T)]
    assert got == [
        ("literal", "a.b"), ("literal", "k"), ("template", "`k.${id}.x`"), ("binary", "'p.' + q"), ("expression", "cond ? 'a' : 'b'"), ("expression", "fn('z', 1)"),
        ("literal", "in.hole"), ("literal", "deep"), ("literal", "it's é"), ("expression", "a"), ("expression", "-x"), ("expression", "x => x + 1"),
        ("literal", "attr"), ("literal", "jsx"), ("binary", "a || 'b'"), ("binary", "typeof a === 'x'"), ("binary", "`a` + `b`"), ("expression", "{k: 'x'}"), ("literal", "open"),
    ]
    assert [r[3] for r in calls.calls(SOURCE, T, members=True) if r[3] in ("m", "br")] == ["m", "br"]
    assert calls.calls("", T) == [] and calls.calls("`${", T) == [] and calls.calls("t(", T) == [] and calls.calls("t('a", T)[0][2] == "expression"


def test_every_character_has_a_token():
    import random

    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(["`", "${", "}", "'", '"', "t(", ")", "\\", "a", " ", "\n", "//", "/*", "*/", "é", "{", "<!--"]) for _ in range(rng.randrange(30)))
        spans = calls.tokens(text)
        assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:])) and all(s < e <= len(text) for _, s, e in spans), text
        calls.calls(text, T, members=True)


def test_places_and_suggestions(spark):
    rows = [(1, "a\n  t('x');\nt(`u.${i}.v`)"), (2, None), (3, ""), (4, "t('k.' + a || b)\nt(`u.${j}.v`)\nt(names.first)\nt((a))"), (5, "nothing"), (1, "t('again')")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "cand_id int, text string, key string")
    scanned = calls.scanned(df)
    assert sorted(tuple(r) for r in calls.references(scanned).collect()) == [(1, "again", 1, 1), (1, "x", 2, 3)]
    dynamic = calls.dynamic_keys(scanned)
    assert sorted((r.cand_id, r.reason, r.line, r.col_no) for r in dynamic.collect()) == [(1, "template", 3, 3), (4, "binary", 1, 3), (4, "expression", 3, 3), (4, "expression", 4, 3), (4, "template", 2, 3)]
    got = {(r.bucket, r.assumption, r.cand_id, r.n_calls) for r in calls.whitelist_suggestions(dynamic).collect()}
    assert got == {("globs", "u.*.v", 1, 2), ("assumptions", "k.a", 4, 1), ("assumptions", "names.first", 4, 1), ("assumptions", "a", 4, 1)}
    kept = calls.not_whitelisted(dynamic, spark.createDataFrame([("u.*.v",), (None,)], "assumption string"))
    assert {r.reason for r in kept.collect()} == {"binary", "expression"}
    groups = calls.grouped_examples(dynamic, "reason", "expression", "cand_id", groups=4, examples=1)
    assert sum(r.n_rows for r in groups.collect()) == 4
    assert calls.scanned(df.where("false")).collect() == []


def test_configuration_values(spark):
    def values(f, *cases):
        return [r.v for r in spark.createDataFrame(list(enumerate(cases)), "i int, c string").select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]

    assert values(config.value_kind, "true", "null", "-1.5", "[1, 2]", "[oops", "[oops]", "'q'", "'", "x", "", None) == ["boolean", "null", "number", "json", "string", "string", "quoted", "string", "string", "string", None]
    assert values(config.plain_value, "'q'", '"a"b"', "x") == ["q", 'a"b', "x"]
    assert values(config.string_list, " a, ,b,", "", None) == [["a", "b"], [], None]
    assert values(config.positive_integer, "12.9", "0", "-3", "x", "", None) == [12, None, None, None, None, None]
    assert values(config.clamped, "500", "7", "x", None) == [200, 7, 20, 20]
    assert values(config.command_tokens, "a  'b c' \"d \\\" e\"f", "'open it", "", None) == [["a", "b c", 'd " e', "f"], ["open it"], [], None]
    assert values(config.path_problem, " ", "a;b", "x" * 321, "src/a.ts", "a\tb") == ["empty", "unsafe", "too-long", None, "unsafe"]
    assert values(config.static_path, "`a..${x}.b`", "('k.l')", "user.name!", "``", None) == ["a.*.b", "k.l", "user.name", "", None]
    assert values(config.manual_assumption, " `.a.${x}..b.` ", "x") == ["a.*.b", "x"]
    assert values(lambda c: config.line_of(c, F.lit(4)), "ab\ncd", "a") == [1, 0] and values(lambda c: config.column_of(c, F.lit(4)), "ab\ncd") == [1]
    assert values(lambda c: config.severity_text(c.cast("int"), F.lit(1), F.lit(2)), "0", "3") == ["1 warning, 2 infos", "3 critical, 1 warning, 2 infos"]

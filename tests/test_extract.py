"""Extraction from source text: what of a fragment is easily lost."""

from lexiloom.operators import extract


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "cand_id long, text string")


def fragments(spark, text):
    return sorted((r.line_no, r.fragment) for r in extract.html_fragments(texts(spark, text)).collect())


def test_text_after_the_last_tag(spark):
    assert fragments(spark, "<b>Name</b> Une forme absente") == [(0, "Name"), (0, "Une forme absente")]
    assert fragments(spark, "<b>Name</b> a > b") == [(0, "Name"), (0, "a > b")]


def test_untagged_lines_inside_markup_only(spark):
    text = "const a = 1;\n<p\n  class='x'>First\n  second line\n  <br>\n  last\n</p>\nrun(a);"
    assert fragments(spark, text) == [(2, "First"), (3, "second line"), (5, "last")]
    assert fragments(spark, '<div className="x" />\nconst q = 1;\nconst s: Array<string> = [];\nrun(s);') == []


def test_mustaches_calls_and_blocks(spark):
    assert fragments(spark, "<p>{{ ok ? 'Yes please' : \"No\" }} x</p>") == [(0, "No"), (0, "Yes please")]
    assert fragments(spark, "<p>{{ t('a.b') }}</p><p>{$t('a.b')}</p><p>{name}</p><p onClick={() => go()}>Go</p>") == [(0, "Go"), (0, "a.b")]
    assert fragments(spark, "<script>\nconst a = '<b>no</b>';\n</script>\n<b>yes</b>") == [(3, "yes")]


def test_every_template_of_a_fragment(spark):
    rows = extract.template_parts(texts(spark, "f(`plain`, `a ${x} b`) + `${y.z}`", "`no hole`")).collect()
    assert sorted((r.cand_id, r.template, r.pos, r.is_param, r.part) for r in rows) == [(0, 0, 0, False, "plain"), (0, 1, 0, False, "a "), (0, 1, 1, True, "x"), (0, 1, 2, False, " b"), (0, 2, 1, True, "y.z")]


def test_every_fallback_with_either_quote(spark):
    text = """t('a.b', 'One') + t("c.d", "It's") + x.t('no', 'no'); t('e.f') || "Two, 'quoted'"; t("g.h", { n }) ?? 'It\\'s'; t('i.j', 'Both') || 'Other'; t('k.l')"""
    got = sorted((r.key, r.fallback) for r in extract.fallback_literals(texts(spark, text)).collect())
    assert got == [("a.b", "One"), ("c.d", "It's"), ("e.f", "Two, 'quoted'"), ("g.h", "It\\'s"), ("i.j", "Both"), ("i.j", "Other")]

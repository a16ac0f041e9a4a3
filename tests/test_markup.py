"""Text in the mark-up of components, from the lexer to rewritten sources."""

from lexiloom.operators import markup
from lexiloom.operators.markup import candidates_of

CATALOG = "locale string, key string, value string, ord long"


def short(text):
    return [(k, a, t, v, text[s:e]) for k, a, t, v, s, e in candidates_of(text)]


def test_text_attributes_and_literals():
    assert short('<p title="Save it" :alt="x" @click="go()">Hello <b>bold one</b> end</p>') == [("attribute", "title", "Save it", "", 'title="Save it"'), ("text", None, "Hello", "", "Hello"), ("text", None, "bold one", "", "bold one"), ("text", None, "end", "", "end")]
    assert short("<A label={'Go on'} n={1}>{'A literal'}{`x`}{cond && <i>In code</i>}</A>") == [("attribute", "label", "Go on", "", "label={'Go on'}"), ("literal", None, "A literal", "", "{'A literal'}"), ("literal", None, "x", "", "{`x`}")]
    assert short("const a: Array<string> = b < c; it's<div/>code here") == [] and short("") == [] and short("<p") == []
    assert short("<script>const x = '<b>no</b>';</script><!-- <b>no</b> --><br>none<p>yes <br/> too</p>") == [("text", None, "yes", "", "yes"), ("text", None, "too", "", "too")]


def test_neighbours_are_one_message():
    assert short("<p>\n  Hi {user.name}, {count} new {user.name}!\n</p>") == [("interpolation", None, "Hi {name}, {count} new {name}!", "name: user.name, count", "Hi {user.name}, {count} new {user.name}!")]
    assert short("<p>{{ a.name }} and {{ b.name }}</p>") == [("interpolation", None, "{name} and {name2}", "name: a.name, name2: b.name", "{{ a.name }} and {{ b.name }}")]
    assert short("<p>{x}</p><p>One {ok ? 1 : 2} two {/* note */} three</p>") == [("text", None, "One", "", "One"), ("text", None, "two three", "", "two {/* note */} three")]


def test_random_sources_never_break():
    import random

    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(["<p>", "</p>", "<br/>", "{", "}", "{{", "}}", "'", '"', "`", "a b", " ", "\n", "<", ">", "=", "t(", "é", "<!--", "-->", "<script>", "</script>", "/*", 'x="y"']) for _ in range(rng.randrange(40)))
        found = candidates_of(text)
        assert all(0 <= s < e <= len(text) for *_, s, e in found) and all(a[5] <= b[4] for a, b in zip(sorted(found, key=lambda c: c[4]), sorted(found, key=lambda c: c[4])[1:])), text


def test_plan_and_rewriting(spark):
    rows = [
        (1, "src/a/Page.tsx", '<div className="flex"><h1 title="Read this now">Save the report</h1><p>Hello {user.name}, welcome back</p></div>'),
        (2, "src/b/Other.vue", '<p title="Read this now">Save the  report</p><i>Known words here</i><b>x</b>'),
        (3, "src/c.tsx", None),
        (4, None, "no markup"),
    ]
    sources = spark.createDataFrame([(*r, "e") for r in rows], "cand_id int, file_path string, text string, key string")
    cat = spark.createDataFrame([("en", "k.known", "Known words here", 1), ("de", "q", "Save the report", 2)], CATALOG)
    plan = markup.planned(sources, cat)
    got = {(r.cand_id, r.text): (r.status, r.reason) for r in plan.collect()}
    assert got == {
        (1, "flex"): ("skipped", "attribute-not-for-people"), (1, "Read this now"): ("pending", None), (1, "Save the report"): ("pending", None), (1, "Hello {name}, welcome back"): ("pending", None),
        (2, "Read this now"): ("duplicate", None), (2, "Save the report"): ("duplicate", None), (2, "Known words here"): ("existing", None), (2, "x"): ("skipped", "single-character"),
    }
    key = {r.text: r.key for r in plan.where("status in ('pending', 'existing')").collect()}
    assert key["Known words here"] == "k.known" and len(set(key.values())) == 4
    out = {r.cand_id: r.text for r in markup.rewritten(sources, plan).collect()}
    assert out[1] == f"<div className=\"flex\"><h1 title={{t('{key['Read this now']}')}}>{{t('{key['Save the report']}')}}</h1><p>{{t('{key['Hello {name}, welcome back']}', {{ name: user.name }})}}</p></div>"
    assert out[2] == f"<p :title=\"$t('{key['Read this now']}')\">{{{{ $t('{key['Save the report']}') }}}}</p><i>{{{{ $t('k.known') }}}}</i><b>x</b>" and set(out) == {1, 2}
    assert markup.upserted(cat, plan).count() == 5
    assert {(r.status, r.n) for r in markup.status_counts(plan).where("reason is null").collect()} == {("pending", 3), ("duplicate", 2), ("existing", 1)}
    none = markup.planned(sources.where("false"), cat)
    assert none.collect() == [] and markup.rewritten(sources, none).collect() == []

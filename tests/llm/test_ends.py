"""The end-of-text counts of problem 1 cover every row."""

import random

from lexiloom.llm import pairs


def likelihoods(texts):
    """(tail, dressed) -> likelihood, counted in the plainest form."""
    out = {}
    for form, dressed in texts:
        p, text = 0.0, f" {form}"
        for order in (0, *pairs.END_CONTEXTS):
            if order <= len(text):
                context = text[len(text) - order :]
                held = sum(context in f" {f}" for f, _ in texts)
                ends = sum(f" {f}".endswith(context) and not d for f, d in texts)
                p = (ends - (not dressed) + pairs.END_PRIOR * p) / (held - 1 + pairs.END_PRIOR)
        out[pairs.end_tail(form), dressed] = p
    return out


def test_ends_are_counted_over_all_rows(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SAMPLE", 5)
    monkeypatch.setattr(pairs, "END_WORDS", 4)
    rng = random.Random(3)
    words = ["save", "the", "report", "now.", "Ärger", "...", "キー", "a", "よ。", "a.b", "?!", "no-", "…"]
    rows = [tuple(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(2)) for _ in range(200)] + [("a", ""), ("a", None), ("a", "?"), ("a", "c."), ("a", "z" * 30)]
    df = spark.createDataFrame([(i, s, "de", t) for i, (s, t) in enumerate(rows)], "row_id long, source_value string, target_locale string, translated_value string").repartition(5)
    tails, dressed = pairs.ends_of(*map(list, zip(*rows)))
    assert {True, False} == set(dressed)
    got = {(r.tail, r.dressed): r.likelihood for r in pairs.end_likelihoods(df, spark.createDataFrame(list(zip(tails, dressed)), "tail string, dressed boolean")).collect()}
    forms = [pairs.end_form(pairs.visible(t or ""))[0] for _, t in rows]
    want = likelihoods([(f, d) for f, d in zip(forms, dressed) if f])
    assert set(got) == set(want) == {x for x in zip(tails, dressed) if x[0]} and len(got) > 50
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_verdict_does_not_depend_on_the_sample(spark, monkeypatch):
    from tests.llm.samples import lines

    rows = [(i, "en", a, "de", b) for i, (a, b) in enumerate(zip(lines("en") * 6, lines("de") * 6))]
    cut = [(1000 + i, "en", lines("en")[i], "de", lines("de")[i][:-9]) for i in range(4)]
    # Eight responses without a full stop end alike: known from all rows, unknown in a sample of one row in seven.
    bare = [(2000 + i, "en", "Please keep the report in the archive.", "de", "Bitte bewahren Sie den Bericht auf im Archivzimmer") for i in range(8)]
    df = spark.createDataFrame(rows + cut + bare, "row_id long, source_locale string, source_value string, target_locale string, translated_value string")
    whole = {r.row_id for r in pairs.found(df).collect() if r.defect == "truncated"}
    monkeypatch.setattr(pairs, "SAMPLE", len(rows + cut + bare) // 7)
    assert whole == {1000, 1001, 1002, 1003} == {r.row_id for r in pairs.found(df).collect() if r.defect == "truncated"}


def test_many_cuts_with_a_hyphen_stay_cuts(spark):
    from tests.llm.samples import lines

    whole = [(i, "en", a, "de", b) for i, (a, b) in enumerate(zip(lines("en"), lines("de")))]
    cut = [(1000 + i, "en", a, "de", b[: b.rindex(" ") + 3] + "-") for i, (a, b) in enumerate(zip(lines("en"), lines("de"))) if b.endswith("Version.")]
    df = spark.createDataFrame(whole + cut, "row_id long, source_locale string, source_value string, target_locale string, translated_value string")
    assert {r.row_id for r in pairs.found(df).collect() if r.defect == "truncated"} == {r[0] for r in cut}


def test_short_but_whole(spark):
    from tests.llm.samples import lines

    en, de = lines("en"), lines("de")
    whole = [(i, "en", f"{en[i % 60]} {en[(i + 3) % 60]}", "de", f"{de[i % 60]} {de[(i + 3) % 60]}") for i in range(240)]
    short = [(1000 + i, "en", f"{en[i]} {en[i + 2]} {en[i + 3]}", "de", de[i]) for i in range(3)]
    cut = [(2000 + i, "en", f"{en[i]} {en[i + 2]}", "de", de[i][:-11] + end) for i, end in enumerate(["", " …", '"', "...", "-"])]
    df = spark.createDataFrame(whole + short + cut, "row_id long, source_locale string, source_value string, target_locale string, translated_value string")
    got = {r.row_id for r in pairs.found(df).collect() if r.defect == "truncated"}
    assert got == {r[0] for r in cut}
    # The shuffled way gives the same.
    pairs.MAX_BROADCAST_ROWS, old = 0, pairs.MAX_BROADCAST_ROWS
    try:
        assert {r.row_id for r in pairs.found(df).collect() if r.defect == "truncated"} == got
    finally:
        pairs.MAX_BROADCAST_ROWS = old

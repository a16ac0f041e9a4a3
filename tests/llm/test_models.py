import numpy as np
import pytest

from lexiloom.llm import bayes, codetext, labels, ngrams, pairs
from tests.llm.samples import PARTS, documents, lines


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, "x") for i, lang, t in documents()], "doc_id long, text string, lang string, code string")


def test_ngram_sums_against_plain_counting():
    table = {2: np.arange(1 << 8, dtype=float)[:, None]}
    texts = ["ab ab", "", "xyz" * 40]
    sums, counts = ngrams.summed(table, 8, texts)
    for t, s, n in zip(texts, sums[:, 0], counts):
        cp, _ = ngrams.codes([t])
        own = [int(ngrams.hashes(cp[i : i + 2], 2, 8)[0]) for i in range(len(cp) - 2)]
        assert (s, n) == (sum(own), len(own))


def test_held_out_accuracy():
    sample = [(i, lang, t) for i, lang, t in documents()]
    sentences, classes = ngrams.training_sentences(sample)
    model = labels.fit(sentences, classes)
    assert model.held_out_accuracy > 0.97
    nb = bayes.fit([s for i, s in enumerate(sentences) if i % 5], classes[np.arange(len(classes)) % 5 > 0])
    held = [s for i, s in enumerate(sentences) if i % 5 == 0]
    assert (nb.log_posteriors(held).argmax(axis=1) == classes[::5]).mean() > 0.97


def test_confidence_is_calibrated():
    """Half of each sentence is taken away, so that many can't be told; confidence must still match accuracy."""
    rng = np.random.default_rng(2)
    sentences, classes = ngrams.training_sentences([(i, lang, t) for i, lang, t in documents()])
    short = [s[k : k + 6] for s, k in ((s, int(rng.integers(0, max(1, len(s) - 6)))) for s in sentences)]
    train = np.arange(len(short)) % 2 == 0
    model = labels.fit([s for s, t in zip(short, train) if t], classes[train])
    logp = model.log_probabilities([s for s, t in zip(short, train) if not t])
    confidence, right = np.exp(logp.max(axis=1)), logp.argmax(axis=1) == classes[~train]
    assert 0.5 < right.mean() < 1 and abs(confidence.mean() - right.mean()) < 0.08
    whole = labels.segments(model, [lines("de")[0] + " " + lines("de")[1], "", None])
    assert whole[0][0][0] == "de" and 0 < whole[0][0][2] <= 1 and whole[1:] == [[], []]


def test_labels(spark, docs):
    text = {k: lines(k)[5] for k in PARTS}
    rows = [(1, "de", text["de"], "e"), (2, "fr_CA", text["de"], "e"), (3, None, text["fr"], "e"), (4, "en", text["en"] + " " + text["es"] + " / " + text["en"], "e"), (5, "de", None, "e"), (6, "de", "", "e"), (7, "en", "API-204", "e"), (8, "xx", "{{count}}", "e"), (9, "DE-at", text["de"] * 300, "e"), (10, "und", text["ja"], "e"), (1, "de", text["de"], "e")]
    imports = spark.createDataFrame(rows, "imp_id long, target_locale string, translated_value string, lang string")
    got = {(r.imp_id, r.seg_no, r.lang) for r in labels.relabelled(imports, docs).collect()}
    assert got == {(2, 0, "de"), (3, 0, "fr"), (4, 1, "en"), (4, 2, "es"), (4, 3, "en"), (10, 0, "ja")}
    full = labels.languages(imports, docs)
    assert {r.imp_id for r in full.collect()} == {1, 2, 3, 4, 9, 10} and full.where("confidence < 0.5").count() == 0
    assert labels.relabelled(imports.where("false"), docs).collect() == [] and labels.relabelled(imports, docs.where("false")).collect() == []


def test_pairs(spark):
    en = lines("en")
    rows, i = [], 0
    for lang in ("de", "fr", "es", "ja"):
        for k, s in enumerate(lines(lang)):
            for _ in range(2):
                i += 1
                rows.append((i, "en", en[k], lang, s))
    two = {k: lines(k) for k in PARTS}
    case = {
        "ok": ("de", en[0], two["de"][0], None),
        "null": ("de", en[0], None, "empty"),
        "blank": ("de", en[0], "​ ", "empty"),
        "markup": ("de", en[0], "<p></p>", "empty"),
        "filler": ("fr", en[0], "[TODO]", "empty"),
        "refusal": ("fr", en[0], "Je suis désolé, mais je ne peux pas traduire ce texte.", "refusal"),
        "product": ("fr", en[0], two["fr"][16], None),
        "copy": ("es", en[0], "[es] " + en[0].upper(), "copy"),
        "accents": ("es", en[0], en[0].replace("e", "é").replace("a", "á"), "copy"),
        "name": ("es", "Zorapune-500X", "Zorapune-500X", None),
        "labelled": ("es", "Plan: Team Zoru; Seats: 4", "Plan: Team Zoru; Seats: 4", None),
        "same language": ("en-GB", en[0], en[0], None),
        "wrong": ("es", en[0], two["de"][0], "wrong_language"),
        "cut": ("de", en[0], two["de"][0][:-12], "truncated"),
        "dots": ("de", en[0], two["de"][0][:-12] + " …", "truncated"),
        "no target": (None, en[0], None, None),
        "long": ("de", en[0] * 200, two["de"][0] * 200, None),
    }
    ids = {}
    for name, (target, source, answer, want) in case.items():
        i += 1
        ids[i] = (name, want)
        rows.append((i, "en", source, target, answer))
    rows.append((i + 1, "en", None, "de", "x"))
    schema = "row_id long, source_locale string, source_value string, target_locale string, translated_value string"
    df = spark.createDataFrame([(*r, "z") for r in rows], schema + ", defect string")
    got = {r.row_id: r.defect for r in pairs.found(df).collect()}
    assert {n: got.get(k) for k, (n, _) in ids.items()} == {n: w for n, w in ids.values()}
    assert set(got) <= set(ids)
    assert pairs.found(df.where("false")).collect() == []


def test_pieces():
    found, code = codetext.pieces("const re = /['\"]x\\/\\/[^']*/g; // one two\nf('a // b', \"c\\u00e9\\\"d\"); /* e\n * f */ `g ${h('i j')} k` <!-- l -->")
    assert found == [("comment", " one two"), ("literal", "a // b"), ("literal", 'cé"d'), ("comment", " e\nf "), ("literal", "i j"), ("literal", "g   k"), ("comment", " l ")]
    assert "re" in code and "one" not in code
    assert codetext.pieces("it's 'open") == ([], "it's 'open") and codetext.pieces("/* open")[0] == [("comment", " open")]


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(1)
    states = codetext.CODE + 1
    e = rng.normal(size=(6, states)).astype(np.float32) * 4

    class Fixed:
        def emissions(self, texts):
            return e, np.zeros(6, np.int64)

    path = codetext._viterbi(Fixed(), ["abc"])[0]

    def score(p):
        t = e[0, p[0]] + (0 if p[0] == codetext.CODE else codetext.ENTER)
        for a, b, row in zip(p, p[1:], e[1:]):
            t += row[b] + (0 if a == b else codetext.ENTER if a == codetext.CODE else codetext.LEAVE if b == codetext.CODE else codetext.CHANGE)
        return t

    # Dynamic programme in its plainest form, over all pairs of states.
    best = {s: (e[0, s] + (0 if s == codetext.CODE else codetext.ENTER), [s]) for s in range(states)}
    for row in e[1:]:
        best = {b: max(((t + row[b] + (0 if a == b else codetext.ENTER if a == codetext.CODE else codetext.LEAVE if b == codetext.CODE else codetext.CHANGE), [*p, b]) for a, (t, p) in best.items()), key=lambda x: x[0]) for b in range(states)}
    want = max(best.values(), key=lambda x: x[0])[1]
    assert score(want) >= score([codetext.CODE] * 6) and list(path) == want[1:4]


def test_code_text(spark, docs):
    de, en, ja = lines("de")[3], lines("en")[9], lines("ja")[2]
    base = ["// eslint-disable-next-line no-unused-vars", "const cls = \"flex items-center gap-2 text-sm\";", "// return auth.empty(null);", "const q = 'SELECT id, title FROM billing WHERE id = ?';", "t('profile.note')", "import { x } from '@/lib/y';"]
    rows = [(k, "f1", "jsx-expression", "\n".join(base)) for k in range(100, 140)]
    rows += [(1, "f1", "jsx-expression", f"// {de}\nlog('%s', x)"), (2, "f1", "call-expression", f"t('a.b', '{en}') // TODO(x): {de}"), (3, "f2", "jsx-text", en), (4, "f2", "jsx-expression", None), (5, "f2", "jsx-expression", ""), (6, "f2", "jsx-expression", "const s = \"" + ja.encode("ascii", "backslashreplace").decode() + "\";"), (7, None, "call-expression", f"/**\n * {en}\n * @param x\n */\n" + "f(x);\n" * 20_000), (8, "f2", "jsx-expression", "t('Save')")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "cand_id long, file_path string, kind string, text string, lang string")
    got = {tuple(r) for r in codetext.found(df, docs).collect()}
    assert got == {(1, "comment", "de"), (2, "literal", "en"), (2, "comment", "de"), (6, "literal", "ja"), (7, "comment", "en")}
    shares = codetext.shares(df, docs).collect()
    per_file = {}
    for r in shares:
        per_file[r.file_path] = per_file.get(r.file_path, 0) + r.share
    assert set(per_file) == {"f1", "f2", None} and all(abs(v - 1) < 1e-9 for v in per_file.values())
    assert codetext.found(df.where("false"), docs).collect() == [] and codetext.found(df, docs.where("false")).collect() == []

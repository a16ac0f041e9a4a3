"""Problem 2's model is trained on every labelled document and every fragment, however many and long they are."""

import numpy as np
import pytest

from lexiloom.llm import bayes, codetext, ngrams
from tests.llm.samples import PARTS, documents, lines

DOCS = "doc_id long, lang string, text string"
FRAGMENTS = "cand_id long, file_path string, kind string, text string"
BASE = "const cls = \"flex items-center gap-2 text-sm\";\nconst q = 'SELECT id, title FROM billing WHERE id = ?';\nimport { x } from '@/lib/y';\n// eslint-disable-next-line no-unused-vars"


def counted(texts):
    cp, _ = ngrams.codes(texts)
    h = {o: ngrams.hashes(cp, o, codetext.BITS) for o in range(1, codetext.ORDER + 1)}
    return {o: np.bincount(x[x >= 0], minlength=1 << codetext.BITS).astype(float) for o, x in h.items()}


def plain(docs, fragments):
    """The training over all rows at once, in its plainest form."""
    per = [set() for _ in ngrams.LANGUAGES]
    names, classes = ngrams.training_sentences(docs)
    kept, kinds = bayes.agreed(names, classes)
    known = dict(zip(kept, kinds.tolist()))
    for s in {s for _, _, text in docs for s in ngrams.sentences(text)}:
        k = known.get(ngrams.clean(ngrams.without_asides(s)))
        if k is not None:
            per[k].add(codetext.emission_form(" ".join(s.split())))
    by_language = [counted(sorted(x)) for x in per]
    code = []
    for f in fragments:
        found, outside = codetext.pieces(f)
        code += [codetext.emission_form(outside), *(codetext.emission_form(t) for _, t in found if codetext.for_tools(t))]
    model = codetext._model(by_language, counted(code))
    texts = [codetext.emission_form(codetext.layout(f).text) for f in fragments]
    for _ in range(codetext.ROUNDS):
        paths = [np.frombuffer(bytes(p), np.int8) for p in codetext.decode(model, texts)]
        own = []
        for t, path in zip(texts, paths, strict=True):
            edges = np.flatnonzero(np.diff(np.r_[False, path == codetext.CODE, False].astype(np.int8)))
            own += [t[a:b] for a, b in zip(edges[::2], edges[1::2])]
        model = codetext._model(by_language, counted(own))
    return model


@pytest.fixture(scope="module")
def rows():
    """More documents and fragments than any sample took, repeated ones too, and French in long documents only."""
    docs = [(i, "en-US" if lang == "en" else lang, t) for i, lang, t in documents() if lang != "fr"]
    docs += [(1_000 + k, "fr", " ".join(lines("fr")) * 12) for k in range(2)]
    docs += [(2_000 + k, "en", f"{lines('en')[k % 64]} The {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100 % 10]}{'efghijklmn'[k // 1000]} list is kept.") for k in range(4_000)]
    docs += [(9_000, "xx", lines("de")[0]), (9_001, None, lines("de")[0]), (9_002, "de", None)]
    fragments = [(k, "f", "call-expression", f"f{k % 6_300}(x, {{ q: '{'abcde'[k % 5]}-{k % 7}' }}); // {lines('de')[k % 64] if k % 9 == 0 else 'eslint-disable'}") for k in range(6_600)]
    fragments += [(10_000, "f", "jsx-expression", BASE), (10_001, "f", "jsx-expression", "@deep.path[0] ?? ~mask;\n" * 900), (10_002, "f", "jsx-text", lines("en")[0]), (10_003, "f", "jsx-expression", None)]
    return docs, fragments


def test_counts_are_those_of_all_rows(spark, rows):
    docs, fragments = rows
    model = codetext._train(spark.createDataFrame(fragments, FRAGMENTS), spark.createDataFrame(docs, DOCS))
    labelled = [(i, lang.split("-")[0], t) for i, lang, t in docs if lang not in (None, "xx") and t is not None]
    want = plain(labelled, [f for _, _, kind, f in fragments if kind in codetext.KINDS and f is not None])
    for order in range(1, codetext.ORDER + 1):
        assert np.array_equal(model.counts[order], want.counts[order])


def test_language_of_long_documents_only(spark):
    docs = [x for x in documents() if x[1] != "fr"] + [(1_000 + k, "fr", " ".join(lines("fr")) * 12) for k in range(2)]
    assert all(len(t) > 20_000 for _, lang, t in docs if lang == "fr")
    told = lines("fr")[9]
    df = spark.createDataFrame([(k, "f", "jsx-expression", BASE) for k in range(40)] + [(100, "f", "call-expression", f'f("{told}");')], FRAGMENTS)
    assert {tuple(r) for r in codetext.found(df, spark.createDataFrame(docs, DOCS)).collect()} == {(100, "literal", "fr")}


def test_counts_keep_their_weight_in_large_tables():
    by_language = [counted([codetext.emission_form(x) for x in lines(lang)] * 150) for lang in [*PARTS, *PARTS]]
    code = counted([codetext.emission_form(BASE)] * 900)
    assert min(x[1].sum() for x in (*by_language, code)) > codetext.LEVEL
    large = [codetext._model([{o: n * c for o, c in x.items()} for x in by_language], {o: n * c for o, c in code.items()}) for n in (1, 1_000)]
    texts = [codetext.emission_form(BASE), codetext.emission_form(lines("en")[9])]
    assert np.allclose(large[0].emissions(texts)[0], large[1].emissions(texts)[0], atol=1e-4)


def test_zero_characters():
    model = codetext._model([counted([])] * len(ngrams.LANGUAGES), counted(["f(x)"]))
    assert [len(p) for p in codetext.decode(model, [codetext.emission_form(t) for t in ("a\0b", "c")])] == [3, 1]


def test_texts_decoded_together_or_alone():
    rng = np.random.default_rng(3)
    shape = (1 << codetext.BITS, codetext.CODE + 1)
    model = codetext.TextModel({o: rng.integers(0, 50, shape).astype(np.float32) for o in range(1, codetext.ORDER + 1)})
    texts = ["", "a", "f(x);", "日本語を 読む", *("".join(rng.choice(list("abc ({é"), int(n))) for n in rng.integers(1, 90, 60))]
    assert codetext.decode(model, texts) == [codetext._viterbi(model, [t])[0].tobytes() for t in texts]

    # Each position's probability, by the formula as it stands.
    def p(text, state, order):
        if order == 0:
            return None
        count = lambda g: float(model.counts[len(g)][ngrams.hashes(ngrams.codes([g])[0][1:-2], len(g), codetext.BITS)[0], state])
        if order == 1:
            return (count(text[-1]) + 0.5) / (float(model.counts[1][:, state].sum()) + 0.5 * 4096)
        return (count(text[-order:]) + codetext.BACK_OFF * p(text, state, order - 1)) / (count(text[-order:-1]) + codetext.BACK_OFF)

    e, owner = model.emissions(["abca", "b"])
    padded = " abca "
    for at in range(len(padded)):
        assert np.allclose(np.exp(e[at, :3]), [p(padded[: at + 1], s, min(at + 1, codetext.ORDER)) for s in range(3)], rtol=1e-4)
    assert owner.tolist() == [0] * 7 + [1] * 4

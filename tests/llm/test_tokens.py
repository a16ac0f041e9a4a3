import os
import random

import pytest
from tokenizers import Tokenizer

from lexiloom.llm import mixture, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"), reason="no tokenizer files here")
ALPHABET = ["a", "B", "1", " ", "  ", "\n", "\t", "'", "s", "ll", "ve", ".", "!", "é", "日本", "。", "　", "́", "‍", "²", "😀", "\x85", "\xa0", "<|endoftext|>", "word ", "don't "]


@pytest.mark.parametrize("leaf", [1, 2, 3, 8, 64, 4096])
def test_tree_equals_whole(leaf):
    random.seed(leaf)
    # The other library's form of the same vocabulary, without any tree.
    other = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    tok = tokens.tokenizer()
    texts = ["".join(random.choices(ALPHABET, k=random.randint(0, 60))) for _ in range(400)] + ["", "x" * 5000, " " * 3000, "日" * 3000, "a1" * 2000]
    whole = [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]
    assert tokens.encode_texts(tok, texts, leaf) == whole
    assert [tokens.decode_ids(tok, i) for i in whole] == texts


def test_ids(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "Hello world", 5), (3, "Hello world", 5), (4, "long text " * 40_000, 5)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in tokens.token_ids(df).collect()}
    assert got[1] == [] and got[2] == [] and got[3] == [15496, 995] and len(got[4]) > 80_000
    assert tokens.token_ids(df.where("false")).collect() == []
    assert {(r.doc_id, r.same) for r in tokens.roundtrip(df).collect()} == {(1, None), (2, True), (3, True), (4, True)}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df.select("doc_id", "text")).collect()}[3] == 2


def corpus(spark):
    random.seed(9)
    rows = [(i, random.choice(["a"] * 6 + ["b"] * 3 + ["c", "unlisted"]), "word " * random.randint(1, 60)) for i in range(1, 1500)]
    rows += [(5000, None, "x y"), (5001, "a", None), (5002, "a", "")]
    return spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, source string, text string, n_tokens int, block int")


def test_mixture(spark):
    weights = spark.createDataFrame([("a", 0.3, 1, 0), ("b", 0.3, 2, 0), ("c", 0.2, 4, 0), ("none", 0.1, 3, 0), ("zero", 0.1, None, 0)], "source string, target_share double, max_repeats int, tokens int")
    m = mixture.Mixture(corpus(spark), weights, shards=7)
    drawn = m.drawn.collect()
    assert len({(r.doc_id, r.repeat) for r in drawn}) == len(drawn) and {r.source for r in drawn} == {"a", "b", "c"}
    assert {r.shard for r in drawn} == set(range(7))
    report = {r.source: r for r in m.report().collect()}
    for s in "abc":
        r = report[s]
        assert abs(r.actual_share - r.asked_share) < 0.004 and r.repeats_used <= r.max_repeats
    assert report["none"].drawn_tokens == 0 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    again = {(r.doc_id, r.repeat, r.shard) for r in mixture.Mixture(corpus(spark).repartition(3), weights, shards=7).drawn.collect()}
    assert again == {(r.doc_id, r.repeat, r.shard) for r in drawn}


def test_splitting_tree():
    import numpy as np

    counts = np.array([40, 7, 0, 90])
    parts = mixture._split(counts, 6, np.random.default_rng(1))
    assert len(parts) == 6 and (sum(parts) == counts).all() and all((p >= 0).all() for p in parts)
    assert max(p.sum() for p in parts) - min(p.sum() for p in parts) <= 2


def test_empty_mixture(spark):
    weights = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    m = mixture.Mixture(corpus(spark).where("false"), weights)
    assert m.drawn.collect() == [] and m.report().collect()[0].actual_share == 0.0
    assert mixture.Mixture(corpus(spark), weights.where("false")).drawn.collect() == []


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixture, "GROUPS", 50)
    rows = [(i, f"s{i % 2000}", "word " * (1 + i % 7)) for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = spark.createDataFrame([(f"s{k}", 1.0 + k % 3, 5) for k in range(2000)], "source string, target_share double, max_repeats int")
    m = mixture.Mixture(docs, weights, shards=5)
    drawn = m.drawn.collect()
    assert len({(r.doc_id, r.repeat) for r in drawn}) == len(drawn) and {r.shard for r in drawn} == set(range(5))
    report = m.report().collect()
    assert len(report) == 2000 and max(r.repeats_used for r in report) == 5
    size = sum(r.drawn_tokens for r in report)
    # Documents are whole, so a source misses its quota by half of its longest one at most.
    assert all(abs(r.drawn_tokens - r.asked_share * size) <= 8 for r in report)


def test_huge_counts_are_split_exactly():
    import numpy as np

    counts = np.array([5 * 10**9, 3, 10**10])
    parts = mixture._split(counts, 4, np.random.default_rng(1))
    assert (sum(parts) == counts).all() and all((p >= 0).all() for p in parts) and max(p.sum() for p in parts) - min(p.sum() for p in parts) <= 1

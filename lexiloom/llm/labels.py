"""Problem 4: the language of each text and of each segment of a mixed text, with a calibrated confidence.

Model: sparse multinomial logistic regression on TF-IDF character n-grams (1 to 4, hashed), trained with
follow-the-regularised-leader and elastic-net penalties on a bounded sample of labelled documents, then calibrated by one
temperature on held-out documents. The fitted weights (2 ** BITS rows for each order) have a fixed size and are broadcast.

A text is cut into sentences; each gets calibrated log-probabilities, and a Viterbi pass over the sentences of one text,
with a fixed cost for each change of language, gives the segments: names, placeholders and short terms carry too little
evidence to pay for a change. No shuffle takes place: texts are independent of each other.

Defined results
* null, empty and blank texts, and texts without words: no row (they have no language).
* repeated rows: each has its rows. An empty table gives an empty result; further columns are ignored.
* an unlabelled corpus (no training document) gives no language to any text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.whitespace import trim_all
from lexiloom.llm import bayes, ngrams
from lexiloom.llm.ngrams import LANGUAGES
from lexiloom.session import spread

BITS = 16
ORDERS = (1, 2, 3, 4)
EPOCHS = 3
BATCH = 256
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
HOLD_OUT = 5
CHANGE_COST = 4.0
MIN_LETTERS = 3


@dataclass
class LanguageModel:
    weights: dict[int, np.ndarray]  # order -> (2 ** BITS, languages), idf included
    idf: dict[int, np.ndarray]
    bias: np.ndarray
    temperature: float
    held_out_accuracy: float

    def log_probabilities(self, cleaned: list[str]) -> np.ndarray:
        """Calibrated log-probabilities; rows of texts without n-grams are uniform."""
        logits, norm = _logits(self, cleaned)
        z = np.where(norm[:, None] > 0, logits, 0) / self.temperature
        z -= z.max(axis=1, keepdims=True, initial=-np.inf)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _logits(model: LanguageModel, cleaned: list[str]) -> tuple[np.ndarray, np.ndarray]:
    tables = {o: np.hstack([w, model.idf[o][:, None] ** 2]) for o, w in model.weights.items()}
    sums, _ = ngrams.summed(tables, BITS, cleaned)
    norm = np.sqrt(sums[:, -1])
    return sums[:, :-1] / np.maximum(norm, 1e-9)[:, None] + model.bias, norm


def _features(cleaned: list[str]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each order: owners and hashes of all n-grams."""
    cp, owner = ngrams.codes(cleaned)
    out = []
    for k, order in enumerate(ORDERS):
        h = ngrams.hashes(cp, order, BITS)
        at = np.flatnonzero(h >= 0)
        out.append((owner[at], h[at] + (k << BITS), order))
    return out


def fit(sentences: list[str], classes: np.ndarray, seed: int = 5) -> LanguageModel | None:
    """FTRL-proximal over mini-batches. Every HOLD_OUT-th sentence is kept for the temperature and the accuracy."""
    n, width = len(sentences), len(LANGUAGES)
    if not n:
        return None
    rng = np.random.default_rng(seed)
    held = np.arange(n) % HOLD_OUT == HOLD_OUT - 1 if n >= 10 * HOLD_OUT else np.zeros(n, bool)
    space = len(ORDERS) << BITS
    parts = _features(sentences)
    owner = np.concatenate([p[0] for p in parts])
    feature = np.concatenate([p[1] for p in parts])
    order = np.argsort(owner, kind="stable")
    owner, feature = owner[order], feature[order]
    # One entry per (sentence, feature) with its count.
    key, tf = np.unique(owner * space + feature, return_counts=True)
    owner, feature = key // space, key % space
    df = np.bincount(feature, minlength=space)
    idf = np.log((1 + n) / (1 + df)) + 1
    value = tf * idf[feature]
    # The scorer sums w * idf over occurrences and divides by the root of the summed idf ** 2 of all occurrences.
    norm = np.sqrt(np.bincount(owner, tf * idf[feature] ** 2, minlength=n))
    value = value / np.maximum(norm[owner], 1e-9)
    start = np.searchsorted(owner, np.arange(n + 1))
    z, acc = np.zeros((space, width), np.float32), np.zeros((space, width), np.float32)
    bias = np.zeros(width)
    train = np.flatnonzero(~held)

    def weights(rows: np.ndarray) -> np.ndarray:
        zz = z[rows]
        w = -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(acc[rows])) / ALPHA + L2)
        return np.where(np.abs(zz) > L1, w, 0)

    share = np.bincount(classes, minlength=width) / n
    balance = np.where(share > 0, np.minimum(5.0, 1 / np.maximum(share * width, 1e-9)), 0)
    for _ in range(EPOCHS):
        for at in range(0, len(train), BATCH):
            pick = train[at : at + BATCH]
            entry = np.concatenate([np.arange(start[i], start[i + 1]) for i in pick])
            local = np.repeat(np.arange(len(pick)), start[pick + 1] - start[pick])
            rows, inverse = np.unique(feature[entry], return_inverse=True)
            w = weights(rows)
            scores = np.zeros((len(pick), width)) + bias
            gathered = w[inverse] * value[entry][:, None]
            for c in range(width):
                scores[:, c] += np.bincount(local, gathered[:, c], minlength=len(pick))
            scores -= scores.max(axis=1, keepdims=True)
            p = np.exp(scores)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), classes[pick]] -= 1
            p *= balance[classes[pick]][:, None]
            g = np.empty((len(rows), width), np.float32)
            for c in range(width):
                g[:, c] = np.bincount(inverse, p[local, c] * value[entry], minlength=len(rows))
            sigma = (np.sqrt(acc[rows] + g**2) - np.sqrt(acc[rows])) / ALPHA
            z[rows] += g - sigma * w
            acc[rows] += g**2
            bias -= 0.02 * p.mean(axis=0)
        train = rng.permutation(train)
    w = np.zeros((space, width), np.float32)
    for at in range(0, space, 1 << 14):
        w[at : at + (1 << 14)] = weights(np.arange(at, at + (1 << 14)))
    model = LanguageModel(
        {o: (w[k << BITS : (k + 1) << BITS] * idf[k << BITS : (k + 1) << BITS, None]).astype(np.float32) for k, o in enumerate(ORDERS)},
        {o: idf[k << BITS : (k + 1) << BITS].astype(np.float32) for k, o in enumerate(ORDERS)},
        bias,
        1.0,
        float("nan"),
    )
    if held.any():
        at = np.flatnonzero(held)
        logits, _ = _logits(model, [sentences[i] for i in at])
        model.held_out_accuracy = float((logits.argmax(axis=1) == classes[at]).mean())

        def loss(t: float) -> float:
            s = logits / t
            s = s - s.max(axis=1, keepdims=True)
            return float(-(s[np.arange(len(at)), classes[at]] - np.log(np.exp(s).sum(axis=1))).mean())

        model.temperature = min((float(t) for t in np.geomspace(0.05, 5, 60)), key=loss)
    return model


def train(documents: DataFrame) -> LanguageModel | None:
    sentences, classes = ngrams.training_sentences(ngrams.labelled_sample(documents))
    return fit(*bayes.agreed(sentences, classes))


def segments(model: LanguageModel, texts: list[str | None]) -> list[list[tuple[str, int, float]]]:
    """For each text its maximal runs of sentences in one language: (language, sentences, confidence).

    The confidence is the calibrated probability of the language, averaged over the run's sentences by their letters.
    """
    parts = [[c for c in (ngrams.clean(ngrams.without_asides(s)) for s in ngrams.sentences(t)) if sum(x.isalpha() for x in c) >= MIN_LETTERS] if t else [] for t in texts]
    flat = [c for p in parts for c in p]
    if not flat:
        return [[] for _ in texts]
    calibrated = model.log_probabilities(flat)
    # For the path alone: one sentence decides no more than so much, and one of few words or letters less.
    trust = np.array([min(1.0, (c.count(" ") + 1) / 4 if c.isascii() or c.count(" ") > 2 else len(c) / 8) for c in flat])
    weight = np.array([len(c) for c in flat], float)
    logp, p_of = np.maximum(calibrated, -12.0) * trust[:, None], np.exp(calibrated)
    out, at = [], 0
    for p in parts:
        own = slice(at, at + len(p))
        out.append([(LANGUAGES[k], b - a, float(np.average(p_of[own][a:b, k], weights=weight[own][a:b]))) for k, a, b in _runs(logp[own])] if p else [])
        at += len(p)
    return out


def _runs(logp: np.ndarray) -> list[tuple[int, int, int]]:
    """The best path as runs of one language: (language, first sentence, end)."""
    n = len(logp)
    best, back = logp[0].copy(), np.zeros((n, logp.shape[1]), np.int64)
    own = np.arange(logp.shape[1])
    for i in range(1, n):
        top = int(best.argmax())
        change = best[top] - CHANGE_COST > best
        back[i] = np.where(change, top, own)
        best = np.where(change, best[top] - CHANGE_COST, best) + logp[i]
    path = [int(best.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    path.reverse()
    out, start = [], 0
    for i in range(1, n + 1):
        if i == n or path[i] != path[start]:
            out.append((path[start], start, i))
            start = i
    return out


def label_language(label: Column) -> Column:
    """The language a label names, by its part before the region; null where it names none of the known ones."""
    code = F.lower(F.substring_index(F.replace(trim_all(label), F.lit("_"), F.lit("-")), "-", 1))
    return F.when(code.isin(*LANGUAGES), code)


SCHEMA = "id long, label string, seg_no int, n_segments int, lang string, n_sentences int, confidence double"


def identified(rows: DataFrame, id_col: str, text_col: str, documents: DataFrame, label: Column | None = None) -> DataFrame:
    """id, label, seg_no, n_segments, lang, n_sentences, confidence.

    seg_no is 0 for a text in one language; the segments of a mixed text count from 1 in reading order. The label travels
    with the id through the operator, so nothing is joined back.
    """
    spark = rows.sparkSession
    fitted = spark.sparkContext.broadcast(train(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fitted.value
        for b in batches:
            found = segments(model, b.column("text").to_pylist()) if model else []
            at = [i for i, segs in enumerate(found) for _ in segs]
            rest = list(zip(*[(k + 1 if len(segs) > 1 else 0, len(segs), *s) for segs in found for k, s in enumerate(segs)])) or [()] * 5
            own = b.select(["id", "label"]).take(pa.array(at, pa.int64()))
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(c, t) for c, t in zip(rest, kinds, strict=True)]], names=["id", "label", "seg_no", "n_segments", "lang", "n_sentences", "confidence"])

    label = F.lit(None).cast("string") if label is None else label
    kept = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(text_col).alias("text"))
    return spread(kept).mapInArrow(run, SCHEMA)


def languages(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """imp_id, seg_no, lang, confidence of every text and segment."""
    return identified(rows, "imp_id", "translated_value", documents).select(F.col("id").alias("imp_id"), "seg_no", "lang", "confidence")


def relabelled(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """imp_id, seg_no, lang: texts whose label is missing or wrong, and all segments of mixed texts."""
    found = identified(rows, "imp_id", "translated_value", documents, label_language(F.col("target_locale")))
    wrong = (F.col("n_segments") > 1) | ~F.col("label").eqNullSafe(F.col("lang"))
    return found.where(wrong).select(F.col("id").alias("imp_id"), "seg_no", "lang")

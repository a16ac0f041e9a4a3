"""Character n-gram naive Bayes over languages."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lexiloom.llm import ngrams
from lexiloom.llm.ngrams import LANGUAGES

BITS = 16
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.05


@dataclass
class NaiveBayes:
    tables: dict[int, np.ndarray]  # order -> log P(n-gram | language), (2 ** BITS, languages)

    def log_likelihoods(self, cleaned: list[str]) -> np.ndarray:
        """Sums of log P over n-grams, divided by the number of orders as these overlap."""
        return ngrams.summed(self.tables, BITS, cleaned)[0] / len(ORDERS)

    def log_posteriors(self, cleaned: list[str]) -> np.ndarray:
        z = self.log_likelihoods(cleaned)
        z -= z.max(axis=1, keepdims=True, initial=-np.inf)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def fit(sentences: list[str], classes: np.ndarray) -> NaiveBayes:
    counts: list[dict[int, np.ndarray]] = []
    for k in range(len(LANGUAGES)):
        own = [s for s, c in zip(sentences, classes, strict=True) if c == k]
        cp, _ = ngrams.codes(own)
        h = {order: ngrams.hashes(cp, order, BITS) for order in ORDERS}
        counts.append({order: np.bincount(x[x >= 0], minlength=1 << BITS) for order, x in h.items()})
    return of_counts(counts)


def of_counts(by_language: list[dict[int, np.ndarray]]) -> NaiveBayes:
    """The model of each language's counts of n-grams by order."""
    tables = {}
    for order in ORDERS:
        counts = np.stack([c[order] for c in by_language], axis=1).astype(float)
        # A language without a single sentence can't win by smoothing alone.
        total = counts.sum(axis=0)
        p = (counts + SMOOTHING) / (total + SMOOTHING * (1 << BITS))
        tables[order] = np.where(total > 0, np.log(p), np.log(1e-9)).astype(np.float32)
    return NaiveBayes(tables)


def agreed(sentences: list[str], classes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The sentences without those whose document is in another language than they are, by a first model."""
    if not sentences:
        return sentences, classes
    sure = fit(sentences, classes).log_likelihoods(sentences).argmax(axis=1) == classes
    return [s for s, ok in zip(sentences, sure, strict=True) if ok], classes[sure]

"""Character n-grams of whole batches at once, hashed into dense tables; sentences; a labelled sample."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "pl", "ru", "ja")
# Bounds of the labelled sample problem 4's model is trained on.
SAMPLE_DOCUMENTS = 3000
SAMPLE_PER_LANGUAGE = 300
LONGEST_SAMPLED = 20_000
CHUNK_CHARS = 250_000
# Sums of table rows are taken over fewer characters, which stay in the cache.
SUMMED_CHARS = 50_000

_DROPPED = re.compile(r"https?://\S+|\{\{[^{}]*\}\}|\$\{[^{}]*\}|`[^`\n]*+`|<[^<>\n]++>|&[a-z]+;|%[sd]|\S+@\S+|\b[a-z][\w-]*(?:\.[a-z][\w-]*)+\b|[a-z]*[-_.]?\d[\da-z._-]*")
# No text without one of these holds anything to drop.
_SUSPECT = re.compile(r"[{$`<&%@\d]|https?:|\.[a-z]")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_OTHER = re.compile(r"[^\w']+|[\d_]+")
_STOP = re.compile(r"(?<=[.!?…])(?=[\s\"'»”’)]*\s)|(?<=[。！？])(?!\s*[)）」』])|\n+|\s+[/|•—]\s+|\r")
# Additions that belong to the sentence before: figures, names, short terms in brackets.
_ASIDE = re.compile(r"\s*(?:\([^()]{0,60}\)|\[[^\[\]]{0,40}\]|（[^（）]{0,40}）)")


def clean(text: str) -> str:
    """Letters in lower case with single blanks; names of variables, addresses, mark-up and digits are dropped."""
    return clean_visible(text if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)))


def clean_visible(text: str) -> str:
    """`clean` of a text in compatibility form without invisible characters."""
    text = text.lower()
    return _OTHER.sub(" ", _DROPPED.sub(" ", text) if _SUSPECT.search(text) else text).strip()


def sentences(text: str) -> list[str]:
    """The sentences of a text in reading order, blank ones left out."""
    return [s for s in (x.strip() for x in _STOP.split(text)) if s]


def without_asides(sentence: str) -> str:
    return _ASIDE.sub(" ", sentence)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ` text ` after each other, ended by 0, and for each position the number of its text."""
    joined = "".join(f" {t} \0" for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.cumsum(cp == 0) - (cp == 0)
    return cp, owner


def hashes(cp: np.ndarray, order: int, bits: int) -> np.ndarray:
    """For each position the hash of the n-gram that starts there; n-grams that cross a 0 have -1."""
    n = len(cp) - order + 1
    if n <= 0:
        return np.empty(0, np.int64)
    return hashed([cp[k : k + n] for k in range(order)], bits)


def hashed(characters: list[np.ndarray], bits: int) -> np.ndarray:
    """The hashes of n-grams given by their first characters, their second ones and so on; those that hold a 0 have -1."""
    n = len(characters[0])
    h = np.full(n, np.uint64(len(characters) * 0x9E3779B97F4A7C15 % (1 << 64)), np.uint64)
    ok = np.ones(n, bool)
    for c in characters:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        ok &= c != 0
    out = (h >> np.uint64(64 - bits)).astype(np.int64)
    out[~ok] = -1
    return out


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded length; a longer text stands alone and is still handled whole."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 3
        if size >= most:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def summed(tables: dict[int, np.ndarray], bits: int, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each (cleaned) text the sum of its n-grams' rows over all tables, and the number of n-grams."""
    width = next(iter(tables.values())).shape[1]
    out, counts = np.zeros((len(texts), width)), np.zeros(len(texts))
    for start, part in chunks(texts, SUMMED_CHARS):
        cp, owner = codes(part)
        own = slice(start, start + len(part))
        # Rows of all orders are added up where their n-grams start, so that each text is summed once.
        at_start = np.zeros((len(cp), width), next(iter(tables.values())).dtype)
        for order, table in tables.items():
            h = hashes(cp, order, bits)
            if not len(h):
                continue
            rows = table.take(np.maximum(h, 0), axis=0)
            rows[h < 0] = 0
            at_start[: len(h)] += rows
            counts[own] += np.bincount(owner[: len(h)][h >= 0], minlength=len(part))
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[own] = np.add.reduceat(at_start, first, axis=0)
    return out, counts


def labelled_sample(documents: DataFrame, *, size: int = SAMPLE_DOCUMENTS, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[int, str, str]]:
    """(doc_id, language, whole text) of about `size` labelled documents, at least about `per_language` of each language.

    Only this bounded sample of labelled rows ever reaches the driver. Rows are picked by a hash of their id, so the sample
    is the same for the same rows in any order. One scan counts the labels, a second one picks.
    """
    lang = F.lower(F.substring_index(F.replace("lang", F.lit("_"), F.lit("-")), "-", 1))
    counts = {r.code: r["n"] for r in documents.select(lang.alias("code")).where(F.col("code").isin(*LANGUAGES)).groupBy("code").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return []
    share = F.lit(0)
    for code, n in counts.items():
        wanted = max(size * n / total, per_language)
        share = F.when(F.col("code") == code, int(min(1.0, wanted / n) * 1_000_000)).otherwise(share)
    rows = documents.select("doc_id", lang.alias("code"), "text").where(F.col("code").isin(*LANGUAGES) & F.col("text").isNotNull())
    picked = rows.where((F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) < share) & (F.length("text") < LONGEST_SAMPLED))
    most = 2 * (size + per_language * len(LANGUAGES))
    return sorted((r.doc_id, r.code, r.text) for r in picked.limit(most).collect())


def training_sentences(sample: list[tuple[int, str, str]]) -> tuple[list[str], np.ndarray]:
    """Distinct cleaned sentences of three words or more (eight letters in Japanese) with the class most documents give them."""
    votes: dict[str, np.ndarray] = {}
    cleaned: dict[str, str] = {}  # sentences recur in many texts
    parted: dict[str, list[str]] = {}
    for _, lang, text in sample:
        k = LANGUAGES.index(lang)
        if text not in parted:
            parted[text] = sentences(text)
        for s in parted[text]:
            c = cleaned.get(s)
            if c is None:
                c = cleaned[s] = clean(without_asides(s))
            if c.count(" ") >= 2 or lang == "ja" and len(c) >= 8 and not c.isascii():
                votes.setdefault(c, np.zeros(len(LANGUAGES)))[k] += 1
    per_class = np.maximum(1.0, sum(votes.values(), np.zeros(len(LANGUAGES))))
    kept = list(votes)
    return kept, np.array([int((votes[c] / per_class**0.5).argmax()) for c in kept], np.int64)

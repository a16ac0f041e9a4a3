"""Problem 9: pages made of repeated key phrases, links or product tags instead of sentences.

Each page gets features of density (links and tags), entropy and variety of words, repetition, and function words, all
turned so that spam lies upwards. Over all pages of a language the centre is the vector of medians, the scale that of
median absolute deviations, and the scatter the covariance of winsorised scores; so a share of spam far below a half
moves none of them. A page is flagged if its squared Mahalanobis distance is beyond `DISTANCE` and its whitened deviation
reaches `ALONG` in the spam direction (all features upwards); nothing else decides. The features are computed in one Arrow
pass and kept without the texts; all statistics are distributed, mergeable aggregates whose results have one row per
language.

Defined results
* null, empty and blank texts, and texts without a word or link: not flagged. Short texts need no least size: their
  features are drawn towards ordinary text, so that few words are little evidence.
* null or unknown language: that of the page's function words, else English. Repeated crawls are judged one by one.
* languages with fewer than `MIN_PAGES` pages share one pooled centre and scatter.
* an empty table gives an empty result; further columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.ngrams import LANGUAGES
from lexiloom.storage import materialize
from lexiloom.session import spread

FEATURES = ("links", "poverty", "entropy", "repetition", "fragments", "function_words")
WINDOW = 50
# Words and characters of ordinary text every page is taken to hold besides its own.
SHRINK_WORDS = 12
SHRINK_CHARS = 60
USUAL_FUNCTION_WORDS = 0.4
MIN_PAGES = 50
# Smallest scale of each feature, so that one that's constant in a language doesn't explode.
FLOOR = (0.08, 0.06, 0.05, 0.10, 0.12, 0.06)
WINSOR = 3.0
RIDGE = 0.15
# Squared distance of an outlier, and its least deviation along the spam direction (robust standard deviations).
DISTANCE = 33.0
ALONG = 2.0
POOLED = "*"

# Function words.
FUNCTION_WORDS = {
    "en": "the a an of to and or in on at for with is are be you your we our that this it as by from can when if not no more than has have will may so before after which who what they must",
    "de": "der die das den dem des ein eine einen einem einer und oder in im auf für mit ist sind sie ihr ihre ihrem wir uns dass diese dieser dieses es als von vom zu zum zur wenn nicht kein keine mehr hat haben wird kann können bevor nach weil sich wie was",
    "fr": "le la les l de d des du un une et ou en sur pour avec est sont vous votre vos nous nos que qu qui ce cette ces il elle au aux par dans pas ne plus si a ont avant après car se s on sans",
    "es": "el la los las de del un una unos y o en sobre para con es son su sus usted nos que quien este esta se al por como cuando no más si ha han hay lo le antes después sin pero",
    "pt": "o a os as de do da dos das um uma e ou em no na nos nas para com é são seu sua você que quem este esta se ao por pelo como quando não mais foi há antes depois sem mas pois",
    "it": "il lo la i gli le l di del della dei delle dell un una e o in nel nella nelle per con è sono tuo tua che chi questo questa si al alla dal dalla da come quando non più ha hanno ci prima dopo senza ma perché",
    "nl": "de het een en of in op voor met is zijn u uw we wij dat die deze dit als van te ten ter wanneer niet geen meer heeft hebben wordt kan kunt moeten voordat na want er aan om naar",
    "pl": "i w we z ze na do od o po za nie to jest są się że który która które jak gdy jeśli aby przed przez dla ten ta czy już ich jej jego oraz ale ponieważ tylko bez może można",
    "ru": "и в во с со на к ко от о об по за не что это как так но или если когда чтобы для из у вы вас вам мы нас нам он она они его её их то же ли бы уже ещё только прежде после без",
}
_FUNCTION_OF: dict[str, list[int]] = {}
for _k, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in set(_words.split()):
        _FUNCTION_OF.setdefault(_w, []).append(_k)
_FUNCTION_LANGUAGES = tuple(FUNCTION_WORDS)
_CODE_BLOCK = re.compile(r"```.*?(?:```|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*+`|\{\{[^{}]*+\}\}")
# Labels and addresses may be of any length; possessive runs keep the search linear.
_ANCHOR = re.compile(r"<a\b[^<>]*+>([^<]*+)</a>|\[([^\[\]\n]*+)\]\([^()\s]++\)", re.I)
_ADDRESS = re.compile(r"(?:https?:)?//\S++|\bwww\.\S++|\b(?:[\w-]++\.)+(?:[a-z]{2,}/\S*+|(?:com|org|net|info|biz|io|shop|[a-z]{2})\b)|<[^<>\n]++>", re.I)
_DOTTED = re.compile(r"\.[^\W_]")
_HASHTAG = re.compile(r"#[^\W\d_]\w+")
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])|(?<=[^\W\d_])(?=\d)")
_UNIT = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\n+|<br>|\s[|•·»>]+\s|[|•·]")
_STOPS = (".", "!", "?", "…", "。", "！", "？", ":")
# What may differ between two tellings of one sentence: a name before it, an aside in brackets, a name after it.
_DRESS = re.compile(r"^\W*[\w-]+:\s|\s*\([^()]*+\)|\s*\[#?[^\[\]]*+\]|\s+–\s+\S+(?=[.!?。]?$)")
_DRESSED = re.compile(r"[:(\[–]")
_WORD = re.compile(r"[^\W\d_]+")
_ASCII_WORD = re.compile(r"[a-z]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_KANA = re.compile("[ぁ-ん]")


def words_of(text: str) -> list[str]:
    """Words in lower case; text of scripts without blanks in pairs of characters."""
    lower = text.lower()
    if lower.isascii():
        return _ASCII_WORD.findall(lower)
    words = _WORD.findall(lower)
    if not _CJK.search(lower):
        return words
    return [p for w in words for p in ([w[i : i + 2] for i in range(0, len(w), 2)] if _CJK.search(w) else (w,))]


def _expected(n: int) -> float:
    """Distinct words that ordinary text shows among `n`."""
    return n**0.93


def _median(values: list[float]) -> float:
    ordered = sorted(values)
    k = len(ordered)
    return (ordered[(k - 1) // 2] + ordered[k // 2]) / 2


def units_of(prose: str) -> tuple[list[tuple[str, bool]], int]:
    """The parts of a page (text, whether it ends like a sentence), and the characters of links and tags nobody explains."""
    linked = 0
    units: list[tuple[str, bool]] = []
    for line in prose.split("\n"):
        if not line or line.isspace():
            continue
        rest, size, links, labels = line, 0, 0, []
        marked = "<" in line
        if marked or "](" in line:
            for m in _ANCHOR.finditer(line):
                size += m.end() - m.start()
                links += 1
                labels.append(m.group(1) or m.group(2))
            if links:
                rest = _ANCHOR.sub(" ", line)
        if marked or "//" in rest or _DOTTED.search(rest):
            addresses = _ADDRESS.findall(rest)
            if addresses:
                links += len(addresses)
                size += sum(map(len, addresses))
                rest = _ADDRESS.sub(" ", rest)
        bare = rest
        if "#" in rest:
            tags = _HASHTAG.findall(rest)
            if tags:
                size += sum(map(len, tags))
                bare = _HASHTAG.sub(" ", rest)
                rest = _HASHTAG.sub(lambda m: " | " + _CAMEL.sub(" ", m.group()[1:]) + " | ", rest)
        # A link that comes with a sentence about it is explained.
        if size and len(_WORD.findall(bare)) < 6 * max(1, links) and len(_CJK.findall(bare)) < 12:
            linked += size
        for part in (*_UNIT.split(rest), *labels):
            part = part.strip() if part else ""
            if part:
                units.append((_DRESS.sub("", part) if _DRESSED.search(part) else part, part.endswith(_STOPS)))
    return units, linked


def features(text: str | None, label: str | None) -> tuple[str, list[float]] | None:
    """The page's language and its features, or None where there's nothing to judge.

    A short page shows little: each feature is drawn towards that of ordinary text by `SHRINK_WORDS` words (links by
    `SHRINK_CHARS` characters) of it, so that the distance needs no least size.
    """
    if not text or not text.strip():
        return None
    # Code is neither sentences nor spam.
    prose = _CODE_BLOCK.sub("\n", text) if "```" in text else text
    prose = _INLINE.sub(" ", prose) if "`" in prose or "{{" in prose else prose
    visible = sum(map(len, prose.split()))
    if not visible:
        return None
    units, linked = units_of(prose)
    listed = [(words_of(u), stop) for u, stop in units]
    counts = Counter(w for ws, _ in listed for w in ws)
    total = sum(counts.values())
    if not total and not linked:
        return None
    hits = [0] * len(_FUNCTION_LANGUAGES)
    for w, c in counts.items():
        for k in _FUNCTION_OF.get(w, ()):
            hits[k] += c
    most = max(hits)
    best = _FUNCTION_LANGUAGES[hits.index(most)] if most else ""
    cjk = 0 if prose.isascii() else sum(c for w, c in counts.items() if _CJK.search(w))
    code = (label or "").strip().lower().replace("_", "-").partition("-")[0]
    if cjk * 2 > total:
        lang, function_share = "ja", 0.5 * sum(c for w, c in counts.items() if _KANA.search(w)) / cjk
    else:
        function_share = most / max(1, total)
        lang = best if function_share >= 0.12 else code if code in LANGUAGES else best or "en"
    # Sentences said twice are no stuffing: each distinct one of five words or more counts once, short units always.
    seen: set[tuple[str, ...]] = set()
    stream: list[str] = []
    loose = 0
    for ws, stop in listed:
        if len(ws) >= 5:
            key = tuple(ws)
            if key in seen:
                continue
            seen.add(key)
        if len(ws) < 4 or not (stop or len(ws) >= 8) or len(set(ws)) < 0.6 * len(ws):
            loose += len(ws)
        stream += ws
    n = len(stream)
    poverty, local, entropies = [], [], []
    for i in range(0, max(1, n - WINDOW // 2), WINDOW):
        s = stream[i : i + WINDOW]
        poverty.append(1 - min(1.0, len(set(s)) / _expected(max(1, len(s)))))
    for i in range(0, max(1, n - WINDOW), 2 * WINDOW):
        s = stream[i : i + 2 * WINDOW]
        pairs = Counter(zip(s, s[1:]))
        local.append(sum(c for c in pairs.values() if c > 1) / max(1, len(s) - 1))
        h = -sum(x / len(s) * math.log2(x / len(s)) for x in Counter(s).values())
        entropies.append(1 - h / math.log2(max(2, len(s))))
    weight = n / (n + SHRINK_WORDS)
    links = linked / (visible + SHRINK_CHARS)
    return lang, [links, *(weight * _median(v) if n else 0.0 for v in (poverty, entropies, local)), loose / (n + SHRINK_WORDS), USUAL_FUNCTION_WORDS - weight * function_share - (1 - weight) * USUAL_FUNCTION_WORDS]


SCHEMA = "doc_id long, lang string, " + ", ".join(f"{f} double" for f in FEATURES)


def page_features(documents: DataFrame) -> DataFrame:
    """doc_id, lang and the features of every page that can be judged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, langs, rows = [], [], []
            for i, text, label in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("lang").to_pylist()):
                f = features(text, label)
                if f:
                    ids.append(i), langs.append(f[0]), rows.append(f[1])
            m = np.array(rows, float).reshape(len(rows), len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), *[pa.array(m[:, k]) for k in range(len(FEATURES))]], names=["doc_id", "lang", *FEATURES])

    kept = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("text is not null")
    return spread(kept).mapInArrow(run, SCHEMA)


def _grouped(df: DataFrame, aggregates: list[Column]) -> dict[str, list]:
    """One row per language (ten at most) and one over all pages, from one job."""
    rows = df.rollup("lang").agg(F.count("*").alias("n"), *aggregates).collect()
    out = {r["lang"] or POOLED: list(r)[2:] for r in rows if r["n"] >= MIN_PAGES or r["lang"] is None}
    return out if POOLED in out else {POOLED: [None] * len(aggregates)}


def _with_statistics(pages: DataFrame, names: tuple[str, ...], values: dict[str, list[list[float]]]) -> DataFrame:
    """`pages` with array columns of its language's statistics: one row for each of the ten languages, hence broadcast."""
    rows = [(lang, *values.get(lang, values[POOLED])) for lang in LANGUAGES]
    schema = "lang string, " + ", ".join(f"{n} array<double>" for n in names)
    table = pages.sparkSession.createDataFrame([(lang, *[[float(x) for x in v] for v in vs]) for lang, *vs in rows], schema)
    return pages.join(F.broadcast(table), "lang")


def distances(pages: DataFrame) -> DataFrame:
    """doc_id, lang, the features, distance (squared) and toward_spam (the deviation along the spam direction)."""
    size = len(FEATURES)
    dims = range(size)
    pages = materialize(pages, "page-features")
    median = lambda c: F.percentile_approx(c, 0.5, 10_000)
    centre = _grouped(pages, [median(f) for f in FEATURES])
    if any(v is None for v in centre[POOLED]):
        return pages.withColumn("distance", F.lit(0.0)).withColumn("toward_spam", F.lit(0.0))
    centred = _with_statistics(pages, ("centre",), {k: [v] for k, v in centre.items()})
    spread = _grouped(centred, [median(F.abs(F.col(FEATURES[k]) - F.get("centre", F.lit(k)))) for k in dims])
    scale = {lang: [max(1.4826 * x, FLOOR[k]) for k, x in enumerate(v)] for lang, v in spread.items()}
    both = {lang: [centre.get(lang, centre[POOLED]), scale.get(lang, scale[POOLED])] for lang in (*LANGUAGES, POOLED)}
    z = F.array(*[(F.col(FEATURES[k]) - F.get("centre", F.lit(k))) / F.get("scale", F.lit(k)) for k in dims])
    scored = _with_statistics(pages, ("centre", "scale"), both).select("doc_id", "lang", *FEATURES, z.alias("z"))
    clipped = [F.greatest(F.lit(-WINSOR), F.least(F.lit(WINSOR), F.get("z", F.lit(k)))) for k in dims]
    pairs = [(i, j) for i in dims for j in dims if i <= j]
    moments = _grouped(scored, [F.avg(clipped[i] * clipped[j]) for i, j in pairs])
    forms: dict[str, list[list[float]]] = {}
    for lang, m in moments.items():
        s = np.zeros((size, size))
        for (i, j), x in zip(pairs, m, strict=True):
            s[i, j] = s[j, i] = x
        s += RIDGE * np.eye(size)
        # The scores' units are robust standard deviations, so only the correlations of the scatter are kept.
        d = np.sqrt(np.diag(s))
        values, vectors = np.linalg.eigh(s / np.outer(d, d))
        values = np.maximum(values, RIDGE)
        white = (vectors / np.sqrt(values)) @ vectors.T
        direction = white @ np.ones(size)
        forms[lang] = [((vectors / values) @ vectors.T).ravel().tolist(), (white @ direction / np.linalg.norm(direction)).tolist()]
    whole = _with_statistics(scored, ("inverse", "direction"), forms)
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    row = lambda i: product(F.slice("inverse", i * size + 1, size), F.col("z"))
    distance = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0.0), lambda t, i: t + F.get("z", i) * row(i))
    return whole.select("doc_id", "lang", *FEATURES, distance.alias("distance"), product(F.col("direction"), F.col("z")).alias("toward_spam"))


def found(documents: DataFrame) -> DataFrame:
    """doc_id of every page that's spam: an outlier in a direction of spam."""
    return distances(page_features(documents)).where((F.col("distance") > DISTANCE) & (F.col("toward_spam") > ALONG)).select("doc_id")

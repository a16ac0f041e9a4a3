"""Problem 1: prompt and response pairs whose response can't be used, each with the kind of its defect.

Two models judge a pair: a character n-gram naive Bayes over languages, trained on a bounded sample of pairs, and an
end-of-text model, the likelihood that a response ends after its last characters, counted over all pairs. Prompt and
response get language posteriors; a response in the prompt's language that holds the prompt's own words is a copy, one
whose posterior speaks against the target is in a wrong language, and one that stops where texts don't stop is truncated.

An end's likelihood is the share of the responses holding its last characters that end there. Those of contexts of
growing length are interpolated, each with the shorter one as its prior, so rare and unknown endings take that of what is
known about them; nothing else decides. A response that ends like a whole text is whole, however short.

The kinds are tested in this order, the first that applies counts: empty, refusal, copy, wrong_language, truncated.
Pairs are decided row by row in one pass. Only counts of ends and contexts are shuffled, and, where distinct ends are
many, the ids and ends (no texts) of the pairs still open, salted as some ends are very common.

Defined results
* null source or null target locale: no defect. Null response: empty.
* a target locale of no known language: only empty and refusal are tested.
* a source without any word (only signs or placeholders): the response is empty only if it shows nothing.
* repeated rows: each is judged on its own. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import bayes, ngrams
from lexiloom.llm.ngrams import LANGUAGES
from lexiloom.session import MAX_BROADCAST_ROWS, spread
from lexiloom.storage import materialize

# Bound of the sample of pairs the language model is trained on.
SAMPLE = 40_000
# Contexts meet by hashes of 46 bits, which leave 17 for the number of a text in its chunk (`ngrams.CHUNK_CHARS` hold no more).
# The words of the bitmap only say which contexts can't be an end.
END_BITS, OWNER_BITS = 46, 17
END_WORDS = 1 << 18
END_CONTEXTS = (1, 3, 5, 8, 12)
# Weight of the shorter context's likelihood, in texts, and the least likelihood of the end of a whole text.
END_PRIOR = 4.0
END_LIKELY = 0.08
SALTS = 8
# Natural log of the odds a response must show against its target language.
WRONG_ODDS = 4.0

# Words that say there is no value, letters only.
FILLERS = frozenset("todo tbd tba tbc na none null nil nan undefined fixme xxx empty missing untranslated nottranslated notranslation notavailable novalue novalueyet pending placeholder unknown blank leer vide vacio vuoto vazio leeg brak пусто нет未訳 未翻訳 なし 該当なし".split())

# How an answerer declines, by language. Messages of a product speak of "we" or of an object instead.
REFUSALS = (
    r"\bi(?:'m| am) (?:really |very |so |truly )?sorry,? but\b|\bi(?:'m| am) (?:not able|unable)\b|\bi (?:can ?not|can't|won't|will not|must decline|have to decline|must refuse) (?:to )?(?:provide|translate|help|assist|answer|fulfil|comply|do|with)",
    r"\bas an? (?:ai|assistant|language model)\b|\bmy guidelines\b|\bdecline to translate\b|\bno translation is (?:given|provided)\b",
    r"\bals (?:ki-?)?assistent\b|\b(?:kann|darf) ich (?:leider )?(?:nicht|hierfür|dafür|keine)|\btut mir leid, aber|\bmeine(?:n|r)? richtlinien\b|\bich kann (?:diesen|das|leider|dabei) .{0,30}nicht",
    r"\ben tant qu'(?:assistant|ia)\b|\bje (?:ne )?(?:suis (?:pas|désolée?,? mais)|dois refuser|peux pas|ne peux|refuse)|\bmes (?:consignes|directives)\b",
    r"\bcomo (?:asistente|ia)\b|\blo siento,? pero no\b|\bno (?:me es posible|puedo) (?:ayudar|traducir|proporcionar|responder)|\bdebo negarme\b|\bmis (?:normas|directrices|pautas)\b",
    r"\bcomo assistente\b|\bsinto muito,? mas\b|\bnão (?:consigo|posso) (?:ajudar|traduzir|fornecer|responder)|\b(?:preciso|devo) recusar\b|\bminhas diretrizes\b",
    r"\bcome assistente\b|\bmi dispiace,? ma\b|\bnon (?:posso|sono in grado di) (?:tradurre|aiutare|fornire|rispondere)|\bdevo rifiutare\b|\bmie linee guida\b",
    r"\bals assistent moet\b|\bspijt me,? maar\b|\bkan ik (?:u |je )?niet helpen\b|\bmoet ik .{0,40}weigeren\b|\bik kan (?:deze|dit|hier) .{0,30}niet\b|\bmijn richtlijnen\b",
    r"\bjako asystent\b|\bprzykro mi,? ale\b|\bnie (?:jestem w stanie|mogę) (?:pomóc|przetłumaczyć|tłumaczyć|udzielić)|\bmuszę odmówić\b|\bmoimi wytycznymi\b",
    r"\bкак (?:помощник|ассистент)\b|\bизвините,? но я\b|\bя не (?:в состоянии|могу)\b|\b(?:вынужден|должен) отказать|\bмоим правилам\b",
    r"申し訳(?:ございません|ありません)が、(?:この|その)(?:文章|テキスト|依頼|ご依頼|翻訳)|翻訳(?:いたしかね|できかね|できません)|お手伝いできません|アシスタントとして|(?:翻訳|回答)は?お断り",
)
# Alternatives that start at a word share one test of that, so that their first letters decide at once.
_AT_WORDS = [y for x in REFUSALS if x.startswith(r"\b") for y in x.removeprefix(r"\b").split(r"|\b")]
_REFUSAL = re.compile(r"\b(?:" + "|".join(_AT_WORDS) + ")|" + "|".join(x for x in REFUSALS if not x.startswith(r"\b")))
_TAGS = re.compile(r"</?[a-zA-Z][^<>]*+>|<!--[^<>]*+-->|&nbsp;")
_PLACEHOLDER = re.compile(r"\{\{[^{}]*\}\}|%[sd]|\{[^{}]*\}")
_LABELLED = re.compile(r"^\W*\w[^:;\n]{0,30}\s?[:：][^;|/\n,]+[;|/\n,]\s*\w[^:;\n]{0,30}\s?[:：]")
_NAME = re.compile(r"^\W*[\w-]+\s*[:—–-]\s")
_WORD = re.compile(r"[^\W_]+")
_PURE_WORD = re.compile(r"(?<![^\W_])[^\W\d_]+(?![^\W_])")
_ACCENT = re.compile("[\u0300-\u036f]")
# The format characters (category Cf) of the basic plane that occur in running text.
_FORMAT = re.compile("[\u00ad\u0600-\u0605\u061c\u06dd\u070f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufff9-\ufffb]")
_CLOSING = " \t\r\n\"'”’»」』)]）*_"
_DOTS = re.compile(r"(?:…|\.{2,})[.…]*+$")
_BLANKS = re.compile(r"\s+")


def visible(text: str) -> str:
    """The text as a reader sees it: compatibility forms, no invisible characters, no empty mark-up."""
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKC", text))
    return _TAGS.sub(" ", text).strip()


def is_filler(shown: str, source: str) -> bool:
    letters = "".join(_WORD.findall(shown.lower()))
    if not letters:
        return not shown or any(c.isalpha() for c in _PLACEHOLDER.sub("", source))
    return letters in FILLERS and letters != "".join(_WORD.findall(source.lower()))


def skeleton(text: str) -> list[str]:
    """Words in lower case without accents."""
    plain = text.lower() if text.isascii() else _ACCENT.sub("", unicodedata.normalize("NFKD", text.lower()))
    return _WORD.findall(plain)


def is_sentence(source: str) -> bool:
    """Whether a source is more than names, codes, placeholders and labelled values."""
    if _LABELLED.search(source):
        return False
    bare = _PLACEHOLDER.sub(" ", _NAME.sub("", source))
    words = _PURE_WORD.findall(bare)
    return len(words) >= 3 or len(words) == 2 and words[1].islower()


def is_copy(source: str, shown: str) -> bool:
    """Whether nearly all of the response's words are the prompt's own, in the prompt's order."""
    a, b = skeleton(source), skeleton(shown)
    if not a or not b:
        return False
    if a == b or len(a) >= 3 and " ".join(a) in " ".join(b):
        return True
    if len(b) < 4:
        return False
    pairs = set(zip(a, a[1:]))
    own = sum(p in pairs for p in zip(b, b[1:]))
    return own >= 0.8 * (len(b) - 1) and own >= 0.5 * (len(a) - 1)


def end_form(shown: str) -> tuple[str, bool]:
    """The text whose end is judged, and whether it was dressed: closing signs, a cut word's hyphen and dots are taken off."""
    form = _BLANKS.sub(" ", shown.lower()).strip().rstrip(_CLOSING)
    dressed = form.endswith(("-", "…", ".."))
    while form.endswith(("-", "…", "..")):
        form = _DOTS.sub("", form).rstrip(_CLOSING + "-")
    return form, dressed


def end_tail(form: str) -> str:
    """What the likelihood of an end depends on: the last characters, after a blank; empty if there are none."""
    return f" {form}"[-max(END_CONTEXTS) :] if form else ""


def ends_of(sources: list[str], responses: list[str | None]) -> tuple[list[str], list[bool]]:
    """The tails of the responses, and whether they're dressed where their prompts aren't."""
    answers = [end_form(visible(r or "")) for r in responses]
    # The prompt matters only to the few that are dressed.
    return [end_tail(a) for a, _ in answers], [d and not end_form(visible(s))[1] for s, (_, d) in zip(sources, answers, strict=True)]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tail, dressed, n, context_length, h for each context an end has; the shortest one is of no characters."""
    for b in batches:
        tails = b.column("tail").to_pylist()
        for order in (0, *END_CONTEXTS):
            at = np.array([i for i, t in enumerate(tails) if len(t) >= order], np.int64)
            # Each piece is ` x \0`: order + 3 positions, the context itself starts at the second one.
            h = ngrams.hashes(ngrams.codes([tails[i][-order:] for i in at])[0], order, END_BITS)[1 :: order + 3][: len(at)] if order else np.zeros(len(at), np.int64)
            own = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([own.column("tail"), own.column("dressed"), own.column("n"), pa.array([order] * len(at), pa.int32()), pa.array(h, pa.int64())], names=["tail", "dressed", "n", "context_length", "h"])


def end_likelihoods(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """tail, dressed, likelihood: how likely a response ends after each distinct end of `ends` (tail, dressed).

    Texts that hold a context and texts that end with it are counted over all responses, so each judged text is among them
    and is subtracted. An end in a hyphen or dots of its own says nothing about where texts end: it counts as held only.
    """
    tails = ends.where("tail != ''").groupBy("tail", "dressed").agg(F.count("*").alias("n"))
    contexts = materialize(tails.mapInArrow(_contexts, "tail string, dressed boolean, n long, context_length int, h long"), "contexts")
    words = contexts.groupBy(F.expr(f"cast(shiftright(h, 6) & {END_WORDS - 1} as int)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("word")).toArrow()
    bitmap = np.zeros(END_WORDS, np.uint64)
    bitmap[words["at"].to_numpy()] = words["word"].to_numpy().view(np.uint64)
    ending = rows.sparkSession.sparkContext.broadcast(bitmap)

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [f for f in (end_form(visible(x))[0] for x in b.column(0).to_pylist()) if f]
            found, counts = [np.zeros(1, np.int64)], [np.array([len(forms)], np.int64)]
            for _, part in ngrams.chunks(forms):
                cp, owner = ngrams.codes(part)
                # Neither the blank before a text nor that after it is one of its characters.
                inside = (cp != 0) & np.append(cp[1:] != 0, False) & np.r_[False, cp[:-1] != 0]
                for order in END_CONTEXTS:
                    h = ngrams.hashes(cp, order, END_BITS)
                    held = np.flatnonzero((h >= 0) & inside[order - 1 :])
                    x = h[held]
                    known = (ending.value[(x >> 6) & (END_WORDS - 1)] >> (x & 63).astype(np.uint64)) & np.uint64(1) == 1
                    # A text counts once for each of its contexts, however often it repeats itself.
                    once = np.unique(x[known] << OWNER_BITS | owner[held[known]]) >> OWNER_BITS
                    values, n = np.unique(once, return_counts=True)
                    found.append(values), counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in (found, counts)], names=["h", "n"])

    texts = spread(rows.select("translated_value").where("translated_value is not null"))
    seen = texts.mapInArrow(holding, "h long, n long").groupBy("h").agg(F.sum("n").alias("seen"))
    ended = contexts.groupBy("h").agg(F.sum(F.when(F.col("dressed"), 0).otherwise(F.col("n"))).alias("ends"))
    known = contexts.select("tail", "dressed", "context_length", "h").join(ended.join(seen, "h"), "h")
    counted = known.groupBy("tail", "dressed").agg(F.sort_array(F.collect_list(F.struct("context_length", "ends", "seen"))).alias("c"))
    own = (~F.col("dressed")).cast("int")
    grown = F.aggregate("c", F.lit(0.0), lambda p, x: (x["ends"] - own + END_PRIOR * p) / (x["seen"] - 1 + END_PRIOR))
    return materialize(counted.select("tail", "dressed", grown.alias("likelihood")), "likelihoods")


def train(rows: DataFrame) -> bayes.NaiveBayes | None:
    """The language model, from about SAMPLE pairs picked by a hash of their id (the whole table where it's smaller).

    Responses carry the language of their target, prompts that of their source. Pairs with the very defects looked for are
    among them; a sentence takes the language most pairs give it, and sentences the first model disagrees with are left out.
    """
    total = rows.count()
    share = int(min(1.0, SAMPLE / max(total, 1)) * 1_000_000)
    picked = rows.where((F.pmod(F.xxhash64(F.lit(7), "row_id"), F.lit(1_000_000)) < share) & F.col("translated_value").isNotNull() & (F.length("translated_value") < ngrams.LONGEST_SAMPLED))
    lines = [(r.row_id, r.source_locale, r.source_value, r.target_locale, r.translated_value) for r in picked.select("row_id", "source_locale", "source_value", "target_locale", "translated_value").limit(2 * SAMPLE).collect()]
    return fit(lines)


def fit(lines: list[tuple]) -> bayes.NaiveBayes | None:
    lines = sorted(lines, key=lambda r: r[0])
    labelled = [(i, code, text) for i, sl, sv, tl, tv in lines for code, text in ((_code(sl), sv), (_code(tl), tv)) if code in LANGUAGES and text]
    sentences, classes = bayes.agreed(*ngrams.training_sentences(labelled))
    return bayes.fit(sentences, classes) if sentences else None


def _code(locale: str | None) -> str:
    return (locale or "").strip().lower().replace("_", "-").partition("-")[0]


def defects(languages: bayes.NaiveBayes | None, locales: list[str | None], sources: list[str], targets: list[str], responses: list[str | None]) -> tuple[list[str | None], list[bool]]:
    """The defect of each pair as far as its end doesn't matter, and whether its end is still to be judged."""
    out: list[str | None] = [None] * len(sources)
    open_end = [False] * len(sources)
    open_rows: list[tuple[int, int, int, str]] = []
    # Prompts recur, one for each target language.
    numbers: dict[tuple[str, str], int] = {}
    for i, (locale, source, target, response) in enumerate(zip(locales, sources, targets, responses, strict=True)):
        shown = visible(response or "")
        if is_filler(shown, source):
            out[i] = "empty"
        elif _REFUSAL.search(shown.lower().replace("’", "'")) and not _REFUSAL.search(source.lower().replace("’", "'")):
            out[i] = "refusal"
        else:
            code = _code(target)
            if code in LANGUAGES:
                open_rows.append((i, LANGUAGES.index(code), numbers.setdefault((source, _code(locale)), len(numbers)), shown))
    if not open_rows or languages is None:
        return out, open_end
    prompts = [visible(source) for source, _ in numbers]
    posteriors = languages.log_posteriors([ngrams.clean_visible(p) for p in prompts])
    # A prompt is in its labelled language unless its posterior speaks against it.
    spoken = posteriors.argmax(axis=1).tolist()
    for k, (_, label) in enumerate(numbers):
        if label in LANGUAGES and posteriors[k][spoken[k]] - posteriors[k][LANGUAGES.index(label)] <= WRONG_ODDS:
            spoken[k] = LANGUAGES.index(label)
    sentence = [is_sentence(p) for p in prompts]
    open_rows = [r for r in open_rows if sentence[r[2]]]
    cleaned = [ngrams.clean_visible(r[3]) for r in open_rows]
    answers = languages.log_posteriors(cleaned)
    best = answers.max(axis=1, initial=-np.inf)
    for k, (i, want, number, shown) in enumerate(open_rows):
        against = float(best[k] - answers[k][want])
        if want != spoken[number] and is_copy(prompts[number], shown):
            out[i] = "copy"
        elif against > WRONG_ODDS and (cleaned[k].count(" ") >= 2 or not cleaned[k].isascii() or against > 2 * WRONG_ODDS):
            out[i] = "wrong_language"
        else:
            open_end[i] = True
    return out, open_end


def found(rows: DataFrame) -> DataFrame:
    """row_id, defect: one row per defective pair."""
    languages = rows.sparkSession.sparkContext.broadcast(train(rows))
    kept = rows.select(F.col("row_id").cast("long").alias("row_id"), "source_locale", "source_value", "target_locale", "translated_value").where("source_value is not null and target_locale is not null")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            locales, sources, targets, responses = (b.column(c).to_pylist() for c in ("source_locale", "source_value", "target_locale", "translated_value"))
            kinds, open_end = defects(languages.value, locales, sources, targets, responses)
            tails, dressed = ends_of(sources, responses)
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(kinds, pa.string()), pa.array(open_end, pa.bool_()), pa.array(tails, pa.string()), pa.array(dressed, pa.bool_())], names=["row_id", "defect", "open_end", "tail", "dressed"])

    judged = materialize(spread(kept).mapInArrow(judge, "row_id long, defect string, open_end boolean, tail string, dressed boolean"), "judged")
    unlikely = end_likelihoods(kept, judged).where(F.col("likelihood") < END_LIKELY).select("tail", "dressed")
    pending = judged.where("open_end").select("row_id", "tail", "dressed")
    if unlikely.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        cut = pending.join(F.broadcast(unlikely), ["tail", "dressed"], "left_semi")
    else:
        salted = unlikely.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        cut = pending.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int")).join(salted, ["tail", "dressed", "salt"], "left_semi")
    return judged.where("defect is not null").select("row_id", "defect").unionByName(cut.select("row_id", F.lit("truncated").alias("defect")))

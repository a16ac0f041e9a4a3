"""Problem 2: natural language inside the comments and string literals of source fragments.

A character-level hidden Markov model has one state for code and one for each language; a state's emissions are character
4-grams with interpolated back-off, and the code state may besides emit any character at the rate `ANY`, as code holds
all sorts of things that no model has seen. Language states are trained on all labelled documents. The code state starts
from what stands outside of comments and literals in all fragments and from literals whose shape says that they're for
tools; then it is re-estimated from the model's own best paths over all fragments.

Every fragment is segmented whole, from its first character to its last, code and text alike; escapes and the gutters of
comments are read as what they stand for. Afterwards the Viterbi spans are restricted to comments and literals: a piece
holds a language if two words or more, parted by blanks (or five letters of a script without blanks), of it lie in that language's spans.

Training counts n-grams where the rows lie: a task hands on its sums by cell of the hashed tables, so that what is shuffled
and collected is bounded by these tables. Sentences are made distinct by a shuffle, as each counts once. Finding the cases
needs no shuffle; the shares per file are sums, pre-aggregated before their shuffle, so that a file with a third of all rows
is no burden.

Defined results
* kinds other than `jsx-expression` and `call-expression`, and null texts: no row. Empty texts: no row.
* a comment or literal that isn't closed: a block comment reaches to the end of the fragment, a quote is taken as code.
* several pieces of one candidate in the same kind and language: one row. Repeated candidates: rows for each id.
* null file paths form one group of the shares. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom import skew
from lexiloom.llm import bayes, ngrams
from lexiloom.llm.ngrams import LANGUAGES
from lexiloom.session import spread
from lexiloom.storage import materialize

KINDS = ("jsx-expression", "call-expression")
ROUNDS = 2
BITS = 16
ORDER = 4
BACK_OFF = 4.0
# Characters a state's counts are brought down to, whatever the tables' size, so that the back-off keeps its weight.
LEVEL = 130_000
ENTER, LEAVE, CHANGE = -6.0, -4.0, -10.0
# Share and rate of characters that the code state emits whatever stands before them.
ANY_SHARE, ANY = 0.2, 1 / 60
CODE = len(LANGUAGES)
_GAP = bytes([CODE])
_CODE_RUN = re.compile(re.escape(_GAP) + b"+")
BATCH = 2048
# Characters whose emissions are looked up together, once for each different four of them.
DECODED_CHARS = 1_000_000
# Largest table that numbers keys by their place in it.
DIRECT = 1 << 22
MIN_WORDS = 2
MIN_LETTERS = 5
MIN_SHARE = 0.5

# The beginnings of text for tools.
DIRECTIVES = re.compile(
    r"^\W*(?:eslint|tslint|prettier|jshint|jslint|istanbul|c8|v8|stylelint|webpack\w*|vite|@?ts-\w+|@(?:ts|jsx|license|preserve|flow|format|generated|vue|noinspection|type|typedef|returns?|see|link|import)\b|noinspection|#region|#endregion|region|endregion|sourcemappingurl|use (?:strict|client|server)|i18n-\w+|global(?:s)?\s+\w+|nosonar|pragma|coverage)\b",
    re.I,
)
QUERY = re.compile(r"^\s*(?:select\b.+\bfrom|insert\s+into|update\b.+\bset|delete\s+from|create\s+(?:table|index|view)|alter\s+table|drop\s+table|with\b.+\bas\s*\(|query\s*\{|mutation\s*[\w({])", re.I | re.S)
_CODE_SHAPE = re.compile(r"=>|[=)\]}]\s*;\s*$|[{=]\s*$|\w\([^()]*\)\s*[;{]?$|^\s*(?:const|let|var|return|import|export|if|for|while|function|class|type|interface)\b[^.!?]*[({;=<]|===|&&|\|\|")
_CLASS = re.compile(r"[a-z\d!:/\[\]().%#_-]+")
_TOKEN = re.compile(
    r"""(?P<regex>(?:(?<=[=(,:\[!&|?{};+])|(?<=[=(,:\[!&|?{};+]\ )|(?<=return\ ))/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)"""
    r"""|(?P<html><!--(?:.*?-->|.*\Z))|(?P<block>/\*(?:.*?\*/|.*\Z))|(?P<line>(?<![:\\])//[^\n]*)"""
    r"""|(?P<dq>"(?:[^"\\\n]|\\.)*")|(?P<sq>(?<![^\W_])'(?:[^'\\\n]|\\.)*')|(?P<tpl>`(?:[^`\\]|\\.)*`)""",
    re.S,
)
_ESCAPE = re.compile(r"\\(u\{[0-9a-fA-F]{1,6}\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\r?\n|.)", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": " ", "f": " ", "v": " ", "0": " "}
_HOLE = re.compile(r"\$\{((?:[^{}]|\{[^{}]*\})*)\}")
_GUTTER = re.compile(r"^[ \t]*(?:\*+|//+)[ \t]?", re.M)
_DIGIT = re.compile(r"\d")
_BLANK = re.compile(r"\s")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿]")


def _unescaped(x: str) -> str:
    if "\\" not in x:
        return x

    def one(m: re.Match) -> str:
        e = m.group(1)
        if e[0] == "u" and len(e) > 1 or e[0] == "x" and len(e) == 3:
            code = int(e[1:].strip("{}"), 16)
            return chr(code) if code < 0x110000 else " "
        return "" if e in ("\n", "\r\n") else _PLAIN.get(e, e)

    out = _ESCAPE.sub(one, x)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any(0xD800 <= ord(c) < 0xE000 for c in out) else out


@dataclass
class Layout:
    """A fragment as it is read, and the ranges of its comments and literals (a template has one for each static part)."""

    text: str
    pieces: list[tuple[str, list[tuple[int, int]]]]


def layout(text: str) -> Layout:
    shown: list[str] = []
    found: list[tuple[str, list[tuple[int, int]]]] = []
    size = 0

    def put(part: str) -> tuple[int, int]:
        nonlocal size
        shown.append(part)
        size += len(part)
        return size - len(part), size

    def walk(source: str) -> None:
        at = 0
        for m in _TOKEN.finditer(source):
            put(source[at : m.start()])
            at, kind, body = m.end(), m.lastgroup, m.group()
            if kind == "html":
                put("<!--")
                inner = body[4:].removesuffix("-->")
                found.append(("comment", [put(inner)]))
                put(body[4 + len(inner) :])
            elif kind == "block":
                put("/*")
                inner = body[2:].removesuffix("*/")
                found.append(("comment", [put(_GUTTER.sub("", inner))]))
                put(body[2 + len(inner) :])
            elif kind == "line":
                put("//")
                found.append(("comment", [put(body[2:])]))
            elif kind in ("dq", "sq"):
                put(body[0])
                found.append(("literal", [put(_unescaped(body[1:-1]))]))
                put(body[-1])
            elif kind == "tpl":
                put("`")
                parts, last, inside = [], 0, body[1:-1]
                for hole in _HOLE.finditer(inside):
                    parts.append(put(_unescaped(inside[last : hole.start()])))
                    put("${")
                    walk(hole.group(1))
                    put("}")
                    last = hole.end()
                parts.append(put(_unescaped(inside[last:])))
                put("`")
                found.append(("literal", parts))
            else:
                put(body)
        put(source[at:])

    walk(text)
    return Layout("".join(shown), found)


def pieces(text: str | Layout) -> tuple[list[tuple[str, str]], str]:
    """(kind, readable text) of every comment and literal, and the code around them."""
    own = layout(text) if isinstance(text, str) else text
    ranges = sorted(r for _, rs in own.pieces for r in rs)
    outside, at = [], 0
    for start, end in ranges:
        outside.append(own.text[at:start])
        at = end
    outside.append(own.text[at:])
    return [(kind, "   ".join(own.text[a:b].strip() if len(rs) > 1 else own.text[a:b] for a, b in rs)) for kind, rs in own.pieces], " ".join(x for x in outside if x)


def for_tools(text: str) -> bool:
    """Text whose shape says that it's for a tool: directives, queries, class lists, commented-out code, single words."""
    if DIRECTIVES.search(text) or QUERY.search(text) or _CODE_SHAPE.search(text):
        return True
    words = text.split()
    if len(words) < MIN_WORDS and len(_UNSPACED.findall(text)) < MIN_LETTERS:
        return True
    return all(_CLASS.fullmatch(w) for w in words) and sum("-" in w.strip("-") or any(c.isdigit() for c in w) for w in words) * 3 >= len(words)


def emission_form(text: str) -> str:
    """The characters the model reads, one for each of the text: lower case, one digit, one blank."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(c.lower()[0] for c in text)
    return _BLANK.sub(" ", _DIGIT.sub("0", lower)).replace("\0", " ")


@dataclass
class TextModel:
    """Counts of character n-grams by state: languages, then code."""

    counts: dict[int, np.ndarray]

    def emissions(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """log P(character | three before it, state) for all positions of all texts, and the texts' numbers."""
        rows, which, owner = self.windows(texts)
        return rows[which], owner

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The emissions of every different run of four characters, each position's run, and the texts' numbers."""
        cp, owner = ngrams.codes(texts)
        which, place = _four(cp)
        padded = np.r_[np.zeros(ORDER - 1, cp.dtype), cp]
        last = [padded[place + k] for k in range(ORDER)]
        p = before = None
        for order in range(1, ORDER + 1):
            c, full = self._rows(last[ORDER - order :], order)
            if order == 1:
                total = self.counts[1].sum(axis=0)
                p = (c + 0.5) / (total + 0.5 * 4096)
            else:
                context, _ = self._rows(last[ORDER - order : -1], order - 1)
                q = (c + BACK_OFF * p) / (context + BACK_OFF)
                p = np.where(full[:, None], q, p)
        p[:, CODE] = (1 - ANY_SHARE) * p[:, CODE] + ANY_SHARE * ANY
        return np.log(p), which, owner

    def _rows(self, characters: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
        """The counts of n-grams given by their characters, none for those that cross the end of a text."""
        h = ngrams.hashed(characters, BITS)
        ok = h >= 0
        c = np.zeros((len(h), CODE + 1), np.float32)
        c[ok] = self.counts[order][h[ok]]
        return c, ok


def _numbered(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense numbers of keys below `size`, and a place of each."""
    if size > DIRECT:
        _, place, number = np.unique(keys, return_index=True, return_inverse=True)
        return number, place
    table = np.zeros(size, np.int32)
    table[keys] = np.arange(1, len(keys) + 1)
    present = np.flatnonzero(table)
    place = table[present].astype(np.int64) - 1
    table[present] = np.arange(len(present))
    return table[keys].astype(np.int64), place


def _four(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each position's number among the different runs of four characters that end there, and a place of each run."""
    one, place = _numbered(cp, 0x110000)
    n = len(place)
    # Before the first text stands what stands between texts.
    pad = one[cp == 0][:1]
    two, place = _numbered(np.r_[pad, one[:-1]] * n + one, n * n)
    n = len(place)
    # A number of its own stands for no pair at all.
    return _numbered(np.r_[n, n, two[:-2]] * n + two, (n + 1) * n)


def _model(by_language: list[dict[int, np.ndarray]], code: dict[int, np.ndarray]) -> TextModel:
    """States see about as many characters each, so that none wins by how much there is of it.

    All rows are in the counts; they're only scaled. Unscaled counts of a large table outweigh the back-off, and what a round
    once took for code by mistake would count as code ever after.
    """
    states = [*by_language, code]
    sizes = [max(1.0, s[1].sum()) for s in states]
    level = min(LEVEL, float(np.median(sizes)))
    return TextModel({o: np.stack([s[o] * min(1.0, level / n) for s, n in zip(states, sizes, strict=True)], axis=1).astype(np.float32) for o in range(1, ORDER + 1)})


def decode(model: TextModel, texts: list[str]) -> list[bytes]:
    """The best path of every text: a state for each of its characters. Texts of like length go through together."""
    out = [b""] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]), reverse=True)
    for start, part in ngrams.chunks([texts[i] for i in order], DECODED_CHARS):
        rows, which, _ = model.windows(part)
        columns = np.ascontiguousarray(rows.T)
        length = np.array([len(t) + 3 for t in part])
        first = np.cumsum(length) - length
        at = 0
        while at < len(part):
            size = min(BATCH, len(part) - at, max(1, ngrams.CHUNK_CHARS // int(length[at])))
            own = slice(at, at + size)
            for i, path in zip(order[start + at :], _paths(columns, which, first[own], length[own]), strict=False):
                out[i] = path.tobytes()
            at += size
    return out


def _viterbi(model: TextModel, texts: list[str]) -> list[np.ndarray]:
    e, owner = model.emissions(texts)
    length = np.bincount(owner, minlength=len(texts))
    order = np.argsort(-length, kind="stable")
    out: list[np.ndarray] = [np.empty(0, np.int8)] * len(texts)
    for i, path in zip(order, _paths(np.ascontiguousarray(e.T), np.arange(len(e)), (np.cumsum(length) - length)[order], length[order]), strict=True):
        out[i] = path
    return out


def _paths(columns: np.ndarray, which: np.ndarray, first: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Best paths of texts that start at `first` and are ordered by falling length; `columns` are the emissions by state."""
    n, steps = len(length), int(length[0])
    step = np.arange(steps)[:, None]
    seen = which[np.minimum(first + step, len(which) - 1)]
    # Scores before each step; texts that have ended are left out, as the longest come first.
    score = np.empty((CODE + 1, steps + 1, n), np.float32)
    score[:CODE, 0], score[CODE, 0] = ENTER, 0
    for k in range(CODE + 1):
        score[k, 1:] = columns[k].take(seen)
    live = np.searchsorted(-length, -step[:, 0], side="left")
    best = np.empty((steps, n), np.float32)
    into = np.empty((steps, n), np.float32)
    for t in range(steps):
        m = live[t]
        languages, code = score[:CODE, t, :m], score[CODE, t, :m]
        top = languages.max(axis=0, out=best[t, :m])
        enter = np.maximum(top + CHANGE, code + ENTER, out=into[t, :m])
        score[:CODE, t + 1, :m] += np.maximum(languages, enter)
        score[CODE, t + 1, :m] += np.maximum(code, top + LEAVE)
    changes = best + CHANGE > score[CODE, :-1] + ENTER
    leaves = best + LEAVE > score[CODE, :-1]
    rows = np.arange(n)
    state = score[:, length, rows].argmax(axis=0)
    path = np.empty((steps, n), np.int8)
    for t in range(steps - 1, -1, -1):
        m = live[t]
        path[t, :m] = state[:m]
        in_code = state[:m] == CODE
        jumps = np.flatnonzero(np.where(in_code, leaves[t, :m], into[t, :m] > score[state[:m], t, rows[:m]]))
        if len(jumps):
            language = in_code[jumps] | changes[t, jumps]
            state[jumps] = np.where(language, score[:CODE, t, jumps].argmax(axis=0), CODE)
    # Without the added blanks and the end mark.
    by_text = np.ascontiguousarray(path.T)
    return [by_text[i, 1 : length[i] - 2] for i in range(n)]


def spans(text: str, path: bytes) -> dict[int, int]:
    """Characters by language of a piece that holds a phrase for people; empty where it holds none."""
    out: dict[int, int] = {}
    letters = sum(map(str.isalpha, text))
    for k in sorted(set(path) - {CODE}):
        own = "".join([c if s == k else "\0" for c, s in zip(text, path, strict=True)])
        # Words stand apart by blanks; what is joined by other signs is one word, as an address is.
        words = [w for w in own.split() if any(len(x) > 1 or not x.isascii() for x in _WORDS.findall(w))]
        unspaced = len(_UNSPACED.findall(own))
        count = sum(map(str.isalpha, own))
        if (len(words) >= MIN_WORDS or unspaced >= MIN_LETTERS) and count >= MIN_LETTERS and (count >= MIN_SHARE * letters or len(words) >= 4):
            out[k] = path.count(k)
    return out


def found_in(model: TextModel, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
    """For each fragment (kind, language, characters) of its comments and literals that hold a phrase."""
    distinct = list(dict.fromkeys(t or "" for t in texts))
    layouts = [layout(t) for t in distinct]
    paths = decode(model, [emission_form(x.text) for x in layouts])
    known: dict[tuple[str, bytes], dict[int, int]] = {}
    out = {}
    for t, own, path in zip(distinct, layouts, paths, strict=True):
        held = []
        if path.strip(_GAP):
            for kind, ranges in own.pieces:
                states = _GAP.join(path[a:b] for a, b in ranges)
                if not states.strip(_GAP):
                    continue
                piece = " ".join(own.text[a:b] for a, b in ranges), states
                if piece not in known:
                    known[piece] = spans(*piece)
                held += [(kind, lang, n) for lang, n in known[piece].items()]
        out[t] = held
    return [out[t or ""] for t in texts]


def _add(sums: np.ndarray, column: int, texts: list[str], times: int = 1) -> None:
    """Adds the n-grams of texts to `sums`: a row for each cell of the hashed tables of all orders, a column for each state."""
    for _, part in ngrams.chunks(texts):
        cp, _ = ngrams.codes(part)
        for o in range(1, ORDER + 1):
            h = ngrams.hashes(cp, o, BITS)
            sums[(o - 1) << BITS : o << BITS, column] += times * np.bincount(h[h >= 0], minlength=1 << BITS)


def _cells(sums: np.ndarray) -> dict[str, pa.Array]:
    """The cells of `sums` that aren't all zero."""
    at = np.flatnonzero(sums.any(axis=1))
    return {"cell": pa.array(at, pa.int32())} | {f"n{k}": pa.array(sums[at, k], pa.int64()) for k in range(sums.shape[1])}


def _schema(columns: int) -> str:
    return ", ".join(["cell int", *(f"n{k} long" for k in range(columns))])


def _total(cells: DataFrame, columns: int) -> list[dict[int, np.ndarray]]:
    """For each column the counts of all tasks by order."""
    table = cells.groupBy("cell").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(columns)]).toArrow()
    at = table.column("cell").to_numpy()
    out = []
    for k in range(columns):
        full = np.zeros(ORDER << BITS)
        full[at] = table.column(f"n{k}").to_numpy()
        out.append({o: full[(o - 1) << BITS : o << BITS] for o in range(1, ORDER + 1)})
    return out


_VOTES = [f"v{k}" for k in range(len(LANGUAGES))]


def _sentences(documents: DataFrame) -> DataFrame:
    """The distinct sentences of labelled documents: cleaned, as the model reads them, and how often each language has them.

    Only sentences of three words or more (eight letters in Japanese) have votes.
    """

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[tuple[str, str], int] = {}
            for code, text in zip(b.column("code").to_pylist(), b.column("text").to_pylist(), strict=True):
                for s in ngrams.sentences(text):
                    n[s, code] = n.get((s, code), 0) + 1
            yield pa.RecordBatch.from_pydict({"s": pa.array([s for s, _ in n], pa.string()), "code": pa.array([c for _, c in n], pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sentences = b.column("s").to_pylist()
            cleans = [ngrams.clean(ngrams.without_asides(s)) for s in sentences]
            all_vote = np.array([c.count(" ") >= 2 for c in cleans], bool)
            long = np.array([len(c) >= 8 and not c.isascii() for c in cleans], bool)
            kept = np.flatnonzero(all_vote | long)
            out = {"c": pa.array([cleans[i] for i in kept], pa.string()), "form": pa.array([emission_form(" ".join(sentences[i].split())) for i in kept], pa.string())}
            for v, lang in zip(_VOTES, LANGUAGES, strict=True):
                out[v] = pa.array(b.column(v).to_numpy()[kept] * (all_vote[kept] | (lang == "ja")), pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    parts = spread(_labelled(documents)).mapInArrow(parted, "s string, code string, n long")
    votes = [F.sum(F.when(F.col("code") == lang, F.col("n")).otherwise(F.lit(0))).alias(v) for v, lang in zip(_VOTES, LANGUAGES, strict=True)]
    return parts.groupBy("s").agg(*votes).mapInArrow(cleaned, ", ".join(["c string", "form string", *(f"{v} long" for v in _VOTES)]))


def _labelled(documents: DataFrame) -> DataFrame:
    lang = F.lower(F.substring_index(F.replace("lang", F.lit("_"), F.lit("-")), "-", 1))
    return documents.select(lang.alias("code"), "text").where(F.col("code").isin(*LANGUAGES) & F.col("text").isNotNull())


def _languages(documents: DataFrame) -> list[dict[int, np.ndarray]]:
    """The n-grams of each language: of all distinct sentences of its class that a first model gives the same class."""
    spark = documents.sparkSession
    sums = [F.sum(v).alias(v) for v in _VOTES]
    sentences = materialize(_sentences(documents), "sentences")
    wordings = materialize(sentences.groupBy("c").agg(*sums, F.count("*").alias("n")).where(" + ".join(_VOTES) + " > 0"), "wordings")
    per_class = np.maximum(1.0, np.array([x or 0 for x in wordings.agg(*sums).first()], float))

    def classes(b: pa.RecordBatch) -> np.ndarray:
        return (np.stack([b.column(v).to_numpy() for v in _VOTES], axis=1) / per_class**0.5).argmax(axis=1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((ORDER << BITS, len(LANGUAGES)), np.int64)
        for b in batches:
            own: list[list[str]] = [[] for _ in LANGUAGES]
            for c, k in zip(b.column("c").to_pylist(), classes(b) if "v0" in b.schema.names else b.column("k").to_pylist(), strict=True):
                own[k].append(c)
            for k, texts in enumerate(own):
                _add(sums, k, texts)
        yield pa.RecordBatch.from_pydict(_cells(sums))

    first = spark.sparkContext.broadcast(bayes.of_counts(_total(wordings.mapInArrow(counted, _schema(len(LANGUAGES))), len(LANGUAGES))))

    def agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = classes(b)
            sure = first.value.log_likelihoods(b.column("c").to_pylist()).argmax(axis=1) == k
            yield pa.RecordBatch.from_pydict({"c": b.column("c"), "k": pa.array(k, pa.int32()), "n": b.column("n")}).filter(pa.array(sure))

    kept = materialize(wordings.mapInArrow(agreed, "c string, k int, n long"), "agreed")
    forms = skew.attach(sentences.select("c", "form"), kept, ["c"], "form").select(F.col("form").alias("c"), "k").distinct()
    out = _total(forms.mapInArrow(counted, _schema(len(LANGUAGES))), len(LANGUAGES))
    first.destroy()
    return out


def _train(candidates: DataFrame, documents: DataFrame) -> TextModel | None:
    """The model of all labelled documents and all fragments; none without a labelled document."""
    if _labelled(documents).isEmpty():
        return None
    spark = candidates.sparkSession
    by_language = _languages(documents)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The fragments as the model reads them with how often they occur, and the cells of what is code by its shape."""
        sums = np.zeros((ORDER << BITS, 1), np.int64)
        for b in batches:
            forms: dict[str, int] = {}
            code: dict[int, list[str]] = {}
            tools: dict[str, bool] = {}
            for text, n in Counter(b.column("text").to_pylist()).items():
                own = layout(text)
                form = emission_form(own.text)
                forms[form] = forms.get(form, 0) + n
                found, outside = pieces(own)
                code.setdefault(n, []).append(emission_form(outside))
                for _, t in found:
                    if t not in tools:
                        tools[t] = for_tools(t)
                    if tools[t]:
                        code[n].append(emission_form(t))
            for n, texts in code.items():
                _add(sums, 0, texts, n)
            yield pa.RecordBatch.from_pydict({"form": pa.array(list(forms), pa.string()), "n": pa.array(list(forms.values()), pa.int64()), "cell": pa.nulls(len(forms), pa.int32()), "n0": pa.nulls(len(forms), pa.int64())})
        cells = _cells(sums)
        size = len(cells["cell"])
        yield pa.RecordBatch.from_pydict({"form": pa.nulls(size, pa.string()), "n": pa.nulls(size, pa.int64())} | cells)

    rows = materialize(spread(_fragments(candidates).select("text")).mapInArrow(read, f"form string, n long, {_schema(1)}"), "fragments")
    model = _model(by_language, _total(rows.where("cell is not null"), 1)[0])
    forms = rows.where("form is not null").select("form", "n")
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)
        model = _model(by_language, _total(forms.mapInArrow(_code_of(shared), _schema(1)), 1)[0])
        shared.destroy()
    return model


def _code_of(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts what the model's best paths leave in the code state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((ORDER << BITS, 1), np.int64)
        for b in batches:
            texts = b.column("form").to_pylist()
            code: dict[int, list[str]] = {}
            for t, n, path in zip(texts, b.column("n").to_pylist(), decode(shared.value, texts), strict=True):
                code.setdefault(n, []).extend(t[m.start() : m.end()] for m in _CODE_RUN.finditer(path))
            for n, own in code.items():
                _add(sums, 0, own, n)
        yield pa.RecordBatch.from_pydict(_cells(sums))

    return run


def _fragments(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("kind").isin(*KINDS) & F.col("text").isNotNull())


SCHEMA = "cand_id long, file_path string, piece_kind string, lang string, n_chars long, text_chars long"


def pieces_by_language(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """cand_id, file_path, piece_kind, lang, n_chars; one row with a null kind per candidate carries text_chars."""
    fitted = candidates.sparkSession.sparkContext.broadcast(_train(candidates, documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fitted.value
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]

            def add(*values) -> None:
                for c, v in zip(cols, values, strict=True):
                    c.append(v)

            texts = b.column("text").to_pylist()
            found = found_in(model, texts) if model else [[] for _ in texts]
            for i, path, text, held in zip(b.column("cand_id").to_pylist(), b.column("file_path").to_pylist(), texts, found):
                sums: dict[tuple[str, int], int] = {}
                for kind, lang, n in held:
                    sums[kind, lang] = sums.get((kind, lang), 0) + n
                for (kind, lang), n in sums.items():
                    add(i, path, kind, LANGUAGES[lang], n, None)
                add(i, path, None, None, None, len(text))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["cand_id", "file_path", "piece_kind", "lang", "n_chars", "text_chars"])

    kept = _fragments(candidates).select(F.col("cand_id").cast("long").alias("cand_id"), "file_path", "text")
    return spread(kept).mapInArrow(run, SCHEMA)


def found(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """cand_id, piece_kind, lang: distinct by construction, as ids are unique."""
    return pieces_by_language(candidates, documents).where("piece_kind is not null").select("cand_id", "piece_kind", "lang")


def shares(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """file_path, lang, n_chars, share: what part of a file's characters each language holds (lang null: the code)."""
    rows = pieces_by_language(candidates, documents)
    # One pass: the languages of a file and its size are summed together, then each language becomes a row.
    sums = [F.sum(F.when(F.col("lang") == k, F.col("n_chars"))).alias(k) for k in LANGUAGES]
    by_file = rows.groupBy("file_path").agg(F.sum("text_chars").alias("total"), *sums)
    rest = F.col("total") - sum((F.coalesce(F.col(k), F.lit(0)) for k in LANGUAGES), F.lit(0))
    held = F.array(*[F.struct(F.lit(k).alias("lang"), F.col(k).alias("n_chars")) for k in LANGUAGES], F.struct(F.lit(None).cast("string").alias("lang"), F.greatest(rest, F.lit(0)).alias("n_chars")))
    long = by_file.select("file_path", "total", F.explode(held).alias("h")).where("h.n_chars > 0")
    return long.select("file_path", F.col("h.lang").alias("lang"), F.col("h.n_chars").alias("n_chars"), F.when(F.col("total") > 0, F.col("h.n_chars") / F.col("total")).alias("share"))

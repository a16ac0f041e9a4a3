"""Problem 7: token ids of a public tokenizer by a monoid tree reduction.

A text is halved recursively down to leaves of `LEAF_CHARS` code points; all leaves of an Arrow batch are encoded in one
call. Two neighbours are joined by re-encoding a window around their border, grown until both of its ends are places
where the tokenizer splits whatever stands on the other side. Such a place is known from the pre-tokenizer: no token
crosses from a letter to a character that isn't one, from a digit to one that isn't, or from anything visible to white
space, and nothing before it is looked at by what follows. Hence encode(xy) = encode(x) + encode(y) there, tokens outside
the window can't change, and the tree gives exactly the ids of the whole text. Where a window finds no such place, it
grows up to the whole of both halves, which is exact as well. Decoding concatenates up the same tree.

Defined results: null and empty texts have the empty list of ids (never null). Texts of blanks only are encoded like any
other; a lone surrogate can't occur in Arrow's UTF-8. Repeated rows each have their ids. Empty tables give empty results;
further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from lexiloom.session import spread

LEAF_CHARS = 4096
WINDOW_CHARS = 64
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"


# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def tokenizer(folder: str = TOKENIZER_DIR, name: str = TOKENIZER):
    """The tokenizer of a rank file. Strings of special tokens in a text are ordinary text."""
    import tiktoken

    with open(f"{folder}/{name}", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encode(tok, texts: list[str]) -> list[list[int]]:
    return [tok.encode_ordinary(t) for t in texts]


def is_cut(text: str, at: int) -> bool:
    """Whether the pre-tokenizer splits before `text[at]` whatever stands around these two characters."""
    if at <= 0 or at >= len(text):
        return True
    a, b = text[at - 1], text[at]
    if a.isspace() or not a.isprintable():
        return False
    if a.isalpha():
        return b.isascii() and not b.isalpha()
    if a.isascii() and a.isdigit():
        return b.isascii() and not b.isdigit()
    return a.isascii() and b in " \n\t"


def _window(text: str, lo: int, mid: int, hi: int, width: int) -> tuple[int, int]:
    """The ends of the smallest window around `mid`, within [lo, hi], that are cuts of the pre-tokenizer."""
    left = right = None
    while left is None or right is None:
        if left is None:
            end = max(lo, mid - width)
            left = next((i for i in range(mid - 1, end, -1) if is_cut(text, i)), lo if end == lo else None)
        if right is None:
            end = min(hi, mid + width)
            right = next((i for i in range(mid + 1, end) if is_cut(text, i)), hi if end == hi else None)
        width *= 2
    return left, right


def _leaves(n: int, leaf: int) -> list[tuple[int, int]]:
    """The leaves of the halving tree over [0, n), left to right."""
    out, todo = [], [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= leaf:
            out.append((lo, hi))
        else:
            mid = (lo + hi) // 2
            todo += [(mid, hi), (lo, mid)]
    return out


def join(tok, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
    """The monoid's product: ids of text[lo:hi] from those of its two parts."""
    if is_cut(text, mid):
        return left + right
    a, b = _window(text, lo, mid, hi, WINDOW_CHARS)
    old_left, old_right, new = _encode(tok, [text[a:mid], text[mid:b], text[a:b]])
    return left[: len(left) - len(old_left)] + new + right[len(old_right) :]


def _reduce(tok, text: str, lo: int, hi: int, leaves: dict[tuple[int, int], list[int]]) -> list[int]:
    if (lo, hi) in leaves:
        return leaves[lo, hi]
    mid = (lo + hi) // 2
    return join(tok, text, lo, mid, hi, _reduce(tok, text, lo, mid, leaves), _reduce(tok, text, mid, hi, leaves))


def encode_texts(tok, texts: list[str | None], leaf: int = LEAF_CHARS) -> list[list[int]]:
    spans = [(k, s) for k, t in enumerate(texts) if t for s in _leaves(len(t), leaf)]
    ids = _encode(tok, [texts[k][lo:hi] for k, (lo, hi) in spans])
    by_text: dict[int, dict[tuple[int, int], list[int]]] = {}
    for (k, s), x in zip(spans, ids, strict=True):
        by_text.setdefault(k, {})[s] = x
    return [_reduce(tok, t, 0, len(t), by_text[k]) if t else [] for k, t in enumerate(texts)]


def decode_ids(tok, ids: list[int], leaf: int = 2048) -> str:
    """Concatenation up the tree; the bytes of the parts are joined before they are read as UTF-8."""
    table = _byte_table(tok)

    def up(lo: int, hi: int) -> bytes:
        if hi - lo <= leaf:
            return b"".join(table[i] for i in ids[lo:hi])
        mid = (lo + hi) // 2
        return up(lo, mid) + up(mid, hi)

    return up(0, len(ids)).decode("utf-8", "replace")


@cache
def _byte_table(tok) -> list[bytes]:
    return [tok.decode_single_token_bytes(i) for i in range(tok.n_vocab)]


def _chunks(b: pa.RecordBatch, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of bounded text, so that a batch of very long texts never stands in memory with all its ids."""
    texts, start, size = b.column("text"), 0, 0
    for i in range(b.num_rows):
        size += len(texts[i].as_py() or "")
        if size >= chars:
            yield b.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < b.num_rows:
        yield b.slice(start)


def token_ids(documents: DataFrame, *, folder: str = TOKENIZER_DIR, name: str = TOKENIZER, leaf: int = LEAF_CHARS) -> DataFrame:
    """doc_id, ids: no shuffle, one pass over the text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(folder, name)
        for whole in batches:
            for b in _chunks(whole):
                ids = encode_texts(tok, b.column("text").to_pylist(), leaf)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, *, folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """The columns of `documents` other than text, with n_tokens (0 for null and empty texts)."""
    others = [f for f in documents.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(folder, name)
        for whole in batches:
            for b in _chunks(whole):
                n = [len(x) for x in encode_texts(tok, b.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in others], pa.array(n, pa.int64())], names=[*[f.name for f in others], "n_tokens"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], "n_tokens long"])
    return spread(documents.select(*[f.name for f in others], "text")).mapInArrow(run, schema)


def roundtrip(documents: DataFrame, *, folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, same: whether decoding the ids gives the text back (null for a null text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(folder, name)
        for whole in batches:
            for b in _chunks(whole):
                texts = b.column("text").to_pylist()
                ids = encode_texts(tok, texts)
                same = [None if t is None else decode_ids(tok, x) == t for t, x in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "same"])

    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, n_tokens long, same boolean")

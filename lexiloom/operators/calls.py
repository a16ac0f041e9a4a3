"""Calls of the translation function in source text, by one lexer pass over Arrow batches.

A token is a comment, a string, a template, a regular expression, a name, a number or a sign. Comments and strings are thus
passed over, holes of templates are read as code, and a call's first argument is what stands between its bracket and the
comma or bracket that ends it at the same depth. Rows are independent of each other and nothing is shuffled.

Defined results
* null and empty texts: no row. A call whose bracket isn't closed reaches to the end of the text.
* calls without an argument: no row. Nested calls are rows of their own.
* lines and columns count from 1; those of a dynamic key are its argument's, as an editor marks it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.functions.config import dynamic_assumption
from lexiloom.session import spread

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>\?\.|=>|===?|!==?|\*\*|&&|\|\||\?\?|<<|>>>?|[<>]=|[+*/%&|^-]=|\+\+|--|.)""",
    re.S,
)
_BINARY = frozenset("+ - * / % == === != !== < > <= >= && || ?? & | ^ << >> >>> ** = += -= *= /= %= &= |= ^= in instanceof".split())
_BEFORE_STRING = frozenset("return case typeof else in of from import default".split())
_OPERAND_ENDS = re.compile(r"[\w$)\]}'\"`]\Z")
_ESCAPE = re.compile(r"\\(u\{[0-9a-fA-F]{1,6}\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order; a template without holes is one token, others have `open`, `hole`, `static` and `close`."""
    out: list[tuple[str, int, int]] = []
    depth: list[int] = []  # open braces inside each template hole
    at, n = 0, len(text)

    def template(start: int, mark: int) -> int:
        """Reads a template's static text from `start`; its token begins at `mark`."""
        i = start
        while i < n:
            c = text[i]
            if c == "\\":
                i += 2
            elif c == "`":
                out.append(("template" if mark < start and text[mark] == "`" else "close", mark, i + 1))
                return i + 1
            elif c == "$" and text[i + 1 : i + 2] == "{":
                out.append(("open" if text[mark] == "`" else "static", mark, i + 2))
                depth.append(0)
                return i + 2
            else:
                i += 1
        out.append(("template" if text[mark : mark + 1] == "`" else "close", mark, n))
        return n

    while at < n:
        c = text[at]
        if c == "`":
            at = template(at + 1, at)
            continue
        if depth and c in "{}":
            if c == "}" and depth[-1] == 0:
                depth.pop()
                at = template(at + 1, at)
                continue
            depth[-1] += 1 if c == "{" else -1
        if c in "'\"" and out and out[-1][0] == "name" and out[-1][2] == at and text[out[-1][1] : at] not in _BEFORE_STRING:
            out.append(("sign", at, at + 1))  # an apostrophe inside of a word of running text
            at += 1
            continue
        m = _TOKEN.match(text, at)
        out.append((m.lastgroup, at, m.end()))
        at = m.end()
    return [t for t in out if t[0] not in ("space", "comment")]


def unescaped(body: str) -> str:
    def one(m: re.Match) -> str:
        e = m.group(1)
        if len(e) > 1:
            code = int(e[1:].strip("{}"), 16)
            return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
        return _PLAIN.get(e, e)

    return _ESCAPE.sub(one, body) if "\\" in body else body


def _classified(text: str, arg: list[tuple[str, int, int]]) -> tuple[str, str | None]:
    """(literal, key) or (reason, None) of an argument's tokens."""
    kind, start, end = arg[0]
    if len(arg) == 1 and kind in ("string", "template"):
        return "literal", unescaped(text[start + 1 : end - 1])
    depth, level, conditional, binary, arrow = 0, 0, False, False, False
    for i, (k, s, e) in enumerate(arg):
        w = text[s:e]
        if k == "open":
            level += 1
        elif k == "close":
            level -= 1
        if level:
            continue
        if w in "([{":
            depth += 1
        elif w in ")]}":
            depth -= 1
        elif not depth and k in ("sign", "name"):
            if w == "=>":
                arrow = True
            elif w == "?":
                conditional = True
            elif w in _BINARY and i and (k == "name" or _OPERAND_ENDS.search(text[arg[i - 1][1] : arg[i - 1][2]])):
                binary = True
    if kind == "open" and arg[-1][0] == "close" and not binary and not conditional and _one_template(arg):
        return "template", None
    return ("binary" if binary and not conditional and not arrow else "expression"), None


def _one_template(arg: list[tuple[str, int, int]]) -> bool:
    level = 0
    for i, (k, _, _) in enumerate(arg):
        level += (k == "open") - (k == "close")
        if not level and i < len(arg) - 1:
            return False
    return True


def calls(text: str, names: frozenset[str], members: bool = False) -> list[tuple[int, int, str, str | None, str]]:
    """(start of the call, start of its argument, literal or reason, key, argument) of every call of one of the names.

    With `members`, calls of a property of that name count as well (`x.t(…)`, `x['t'](…)`).
    """
    ts = tokens(text)
    out = []
    for i, (kind, start, end) in enumerate(ts):
        called = i + 1
        if kind == "name" and text[start:end] in names:
            before = text[ts[i - 1][1] : ts[i - 1][2]] if i else ""
            if before in (".", "?."):
                if not members:
                    continue
                while i >= 2 and text[ts[i - 1][1] : ts[i - 1][2]] in (".", "?.") and ts[i - 2][0] == "name":
                    i -= 2
                start = ts[i][1]
            elif before == "function":
                continue
        elif members and kind == "string" and text[start + 1 : end - 1] in names and 0 < i < len(ts) - 1 and text[ts[i - 1][1] : ts[i - 1][2]] == "[" and text[ts[i + 1][1] : ts[i + 1][2]] == "]":
            called = i + 2
            start = ts[max(0, i - 2)][1]
        else:
            continue
        if called >= len(ts) or text[ts[called][1] : ts[called][2]] != "(":
            continue
        depth, level, k = 0, 0, called + 1
        while k < len(ts):
            w = text[ts[k][1] : ts[k][2]]
            level += (ts[k][0] == "open") - (ts[k][0] == "close")
            if not level and ts[k][0] == "sign":
                if w in "([{":
                    depth += 1
                elif w in ")]}":
                    if not depth:
                        break
                    depth -= 1
                elif w == "," and not depth:
                    break
            k += 1
        arg = ts[called + 1 : k]
        if arg:
            what, key = _classified(text, arg)
            out.append((start, arg[0][1], what, key, text[arg[0][1] : arg[-1][2]]))
    return out


SCHEMA = "cand_id long, kind string, key string, expression string, line int, col_no int"


def scanned(texts: DataFrame, identifiers: tuple[str, ...] = ("t",), members: bool = False, id_col: str = "cand_id", text_col: str = "text") -> DataFrame:
    """cand_id, kind (literal, template, binary, expression), key, expression, line, col_no of every call of an identifier."""
    names = frozenset(identifiers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = calls(text, names, members)
                breaks = [m.start() for m in re.finditer("\n", text)] if found else []
                for start, arg, what, key, expression in found:
                    at = start if what == "literal" else arg
                    line = bisect_right(breaks, at - 1)
                    row = (i, what, key, expression, line + 1, at - (breaks[line - 1] + 1 if line else 0) + 1)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["cand_id", "kind", "key", "expression", "line", "col_no"])

    # Only texts that name an identifier are handed to Python.
    held = F.lit(False)
    for name in identifiers:
        held = held | F.col(text_col).contains(name)
    return spread(texts.select(F.col(id_col).cast("long").alias("cand_id"), F.col(text_col).alias("text")).where(held)).mapInArrow(run, SCHEMA)


def references(rows: DataFrame) -> DataFrame:
    """cand_id, key, line, col_no of the calls with a literal key."""
    return rows.where("kind = 'literal'").select("cand_id", "key", "line", "col_no")


def dynamic_keys(rows: DataFrame) -> DataFrame:
    """cand_id, reason, expression, line, col_no of the calls whose key is only known when the code runs."""
    return rows.where("kind <> 'literal'").select("cand_id", F.col("kind").alias("reason"), "expression", "line", "col_no")


def whitelist_suggestions(dynamic: DataFrame) -> DataFrame:
    """bucket, assumption, expression, cand_id, line, n_calls: what to assume for dynamic keys, each with its first call."""
    made, bucket = dynamic_assumption(F.col("expression"), F.col("reason"))
    rows = dynamic.withColumn("assumption", made).withColumn("bucket", bucket).where("assumption is not null")
    first = F.min(F.struct("cand_id", "line", "col_no", "expression")).alias("first")
    return rows.groupBy("bucket", "assumption").agg(first, F.count("*").alias("n_calls")).select("bucket", "assumption", F.col("first.expression").alias("expression"), F.col("first.cand_id").alias("cand_id"), F.col("first.line").alias("line"), "n_calls")


def not_whitelisted(dynamic: DataFrame, assumptions: DataFrame) -> DataFrame:
    """The dynamic keys whose derived assumption isn't among those made already (assumption)."""
    made, _ = dynamic_assumption(F.col("expression"), F.col("reason"))
    return dynamic.withColumn("assumption", made).join(assumptions.select("assumption").distinct(), "assumption", "left_anti").drop("assumption")


def grouped_examples(rows: DataFrame, by: str, value: str, order: str, groups: int = 20, examples: int = 5) -> DataFrame:
    """The first `groups` rows in order, grouped by `by`, with the number of rows and the first `examples` values of each."""
    top = rows.orderBy(order, value).limit(groups)
    numbered = top.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(order, value)))
    return numbered.groupBy(by).agg(F.count("*").alias("n_rows"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= examples, F.struct("n", value)))), lambda x: x[value]), ",").alias("examples"))

"""Text in the mark-up of components: what to extract, under which key, and the sources rewritten to use it.

One lexer pass over Arrow batches reads tags, attributes, text and braces of each source with their places. Everything else
is plans: skip reasons, keys, duplicates, values the catalog has already, collisions of keys, and edits that are spliced in.

Text and simple expressions that follow each other inside of one element are one message with variables; an element or a
complex expression between them ends it. Scripts, styles, comments and code outside of elements are passed over.

Defined results
* null and empty texts: no row. Tags that aren't closed end with the text. Places are characters, counted from 0.
* several sources with one text for people: one key, that of the first in order of id and place; the others are duplicates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import keys, texts
from lexiloom.functions.expressions import is_translatable_attribute
from lexiloom.functions.whitespace import collapse, trim_all
from lexiloom.operators import edits, report
from lexiloom.operators.sync import of_locale
from lexiloom.session import spread
from lexiloom.skew import attach
from lexiloom.storage import materialize

# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_TAG = re.compile(r"<(/?)([A-Za-z][\w.:-]*)(?=[\s/>])")
_CLOSING = re.compile(r"</([A-Za-z][\w.:-]*)")
_ATTRIBUTE = re.compile(r"""\s*([^\s=<>"'/{}]+)(?:\s*=\s*("[^"]*"|'[^']*'|(?=\{)|[^\s<>"'{}]+))?""")
_SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_IN_BRACES = re.compile(r"""'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`|/\*.*?\*/|[{}]""", re.S)
_SIMPLE = re.compile(r"[A-Za-z_$][\w$]*(?:\??\.[A-Za-z_$][\w$]*)*(?:\(\s*\))?\Z")
_LITERAL = re.compile(r"""'((?:[^'\\\n]|\\.)*)'\Z|"((?:[^"\\\n]|\\.)*)"\Z|`([^`$\\]*)`\Z""")
_NAME = re.compile(r"([A-Za-z_$][\w$]*)(?:\(\s*\))?\Z")


def _braces(text: str, at: int) -> int:
    """The end of the braces that open at a place; the text's end where they aren't closed."""
    depth = 0
    for m in _IN_BRACES.finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m.group(), 0)
        if not depth:
            return m.end()
    return len(text)


def _message(parts: list[tuple[str, str, int, int]], out: list[tuple]) -> None:
    """One candidate for parts (text or expression) that follow each other, trimmed at both ends."""
    while parts and parts[0][0] == "text" and not parts[0][1].strip():
        parts = parts[1:]
    while parts and parts[-1][0] == "text" and not parts[-1][1].strip():
        parts = parts[:-1]
    if not any(kind == "text" for kind, *_ in parts):
        return
    template, variables, taken = [], [], {}
    for kind, body, _, _ in parts:
        if kind == "text":
            template.append(body)
            continue
        name = base = _NAME.search(body).group(1)
        number = 2
        while taken.get(name, body) != body:
            name, number = f"{base}{number}", number + 1
        if name not in taken:
            taken[name] = body
            variables.append(f"{name}: {body}" if name != body else name)
        template.append("{" + name + "}")
    first, last = parts[0], parts[-1]
    start = first[2] + (len(first[1]) - len(first[1].lstrip()) if first[0] == "text" else 0)
    end = last[3] - (len(last[1]) - len(last[1].rstrip()) if last[0] == "text" else 0)
    out.append(("interpolation" if variables else "text", None, " ".join("".join(template).split()), ", ".join(variables), start, end))


def candidates_of(text: str) -> list[tuple[str, str | None, str, str, int, int]]:
    """(kind, attribute, text, variables, start, end) of text, literals and attributes in a source's mark-up."""
    out: list[tuple] = []
    parts: list[tuple[str, str, int, int]] = []
    depth, at, n = 0, 0, len(text)
    # In code a name before `<` means a type's parameter, unless that element is closed somewhere.
    closed = set(_CLOSING.findall(text))

    def close() -> None:
        nonlocal parts
        _message(parts, out)
        parts = []

    while at < n:
        c = text[at]
        if c == "<":
            skipped = _SKIPPED.match(text, at)
            tag = None if skipped else _TAG.match(text, at)
            if skipped or tag and (depth or not at or not (text[at - 1].isalnum() or text[at - 1] in "_$") or tag.group(2) in closed):
                close()
                if skipped:
                    at = skipped.end()
                    continue
                at = tag.end()
                while at < n and text[at] != ">" and not text.startswith("/>", at):
                    if text[at] == "{":
                        at = _braces(text, at)
                        continue
                    m = _ATTRIBUTE.match(text, at)
                    if not m or m.end() == at:
                        at += 1
                        continue
                    name, value = m.group(1), m.group(2)
                    at = m.end()
                    if value and value[0] in "\"'" and not name.startswith((":", "@", "v-", "#")):
                        out.append(("attribute", name, value[1:-1], "", m.start(1), at))
                    elif value == "" and text[at : at + 1] == "{":
                        end = _braces(text, at)
                        literal = _LITERAL.match(text[at + 1 : end - 1].strip())
                        if literal:
                            out.append(("attribute", name, next(g for g in literal.groups() if g is not None), "", m.start(1), end))
                        at = end
                own = text.startswith("/>", at) or tag.group(2).lower() in VOID
                at = min(n, at + (2 if text.startswith("/>", at) else 1))
                depth = max(0, depth - 1) if tag.group(1) else depth if own else depth + 1
                continue
        if not depth:
            at += 1
            continue
        if c == "{":
            end = _braces(text, at)
            body = text[at:end].strip("{}").strip()
            literal = _LITERAL.match(body)
            if body.startswith("/*"):
                pass
            elif literal:
                close()
                out.append(("literal", None, next(g for g in literal.groups() if g is not None), "", at, end))
            elif _SIMPLE.match(body):
                parts.append(("expression", body, at, end))
            else:
                close()
            at = end
            continue
        end = at + 1
        while end < n and text[end] not in "<{":
            end += 1
        if parts and parts[-1][0] == "text":
            parts[-1] = ("text", parts[-1][1] + text[at:end], parts[-1][2], end)
        else:
            parts.append(("text", text[at:end], at, end))
        at = end
    if depth:
        close()
    return out


SCHEMA = "cand_id long, file_path string, kind string, attribute string, text string, variables string, start long, end long"


def candidates(sources: DataFrame) -> DataFrame:
    """cand_id, file_path, kind (text, interpolation, literal, attribute), attribute, text, variables, start, end of each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [candidates_of(t) for t in b.column("text").to_pylist()]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            columns = list(zip(*[c for f in found for c in f])) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            own = b.select(["cand_id", "file_path"]).take(at)
            yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["cand_id", "file_path", "kind", "attribute", "text", "variables", "start", "end"])

    kept = sources.where(F.col("text").contains("<")).select(F.col("cand_id").cast("long").alias("cand_id"), "file_path", "text")
    return spread(kept).mapInArrow(run, SCHEMA)


def planned(sources: DataFrame, catalog: DataFrame, source: str = "en", space: str = "app") -> DataFrame:
    """The candidates with reason, key and status: skipped, existing, pending, duplicate or collision.

    Attributes that aren't for people, and texts the filter leaves out, are skipped. A text the source catalog has takes the
    first key of its value; of the others the first occurrence is pending, its key moved where it collides with one held.
    """
    found = candidates(sources).withColumn("text", trim_all(F.col("text")))
    hidden = F.when((F.col("kind") == "attribute") & ~is_translatable_attribute(F.col("attribute")), "attribute-not-for-people")
    rows = found.withColumn("reason", F.coalesce(hidden, texts.skip_reason(F.col("text"), attribute=F.col("attribute"))))
    # Written once: the lexer, the long rules and the moves of keys aren't worked out again for each use of the plan.
    rows = materialize(rows, "markup-candidates")
    skipped = rows.where("reason is not null").select("*", F.lit(None).cast("string").alias("key"), F.lit("skipped").alias("status"))
    place = F.struct("cand_id", "start", "file_path", "attribute", "kind")
    wanted = rows.where("reason is null").withColumn("folded", collapse(F.col("text")))
    messages = wanted.groupBy("folded").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    held = of_locale(catalog, source).groupBy(collapse(F.col("value")).alias("folded")).agg(F.min("key").alias("held"))
    made = keys.full_key(space, F.col("first.file_path"), F.col("first.attribute"), F.col("folded"), F.col("first.kind"))
    named = messages.join(held, "folded", "left").select("folded", "first", "n", "held", F.when(F.col("held").isNull(), made).alias("made"))
    named = materialize(named, "markup-messages")
    moved = report.resolved_keys(named.select(F.col("made").alias("key")), catalog).select(F.col("key").alias("made"), F.col("made").alias("free"), F.col("status").alias("moved"))
    settled = named.join(moved, "made", "left").select("folded", "n", F.col("first.cand_id").alias("first_id"), F.col("first.start").alias("first_start"), "held", "free", "moved")
    whole = attach(wanted, settled, ["folded"], "cand_id")
    first = (F.col("cand_id") == F.col("first_id")) & (F.col("start") == F.col("first_start"))
    status = F.when(F.col("held").isNotNull(), "existing").when(F.col("moved") == "skipped", "collision").when(first, "pending").otherwise("duplicate")
    return materialize(skipped.unionByName(whole.select(*found.columns, "reason", F.coalesce("held", "free").alias("key"), status.alias("status"))), "markup-plan")


def status_counts(plan: DataFrame) -> DataFrame:
    """status, reason, n of a plan."""
    return plan.groupBy("status", "reason").agg(F.count("*").alias("n"))


def replacement(style: str = "react") -> Column:
    """The source text that stands in place of a candidate: a call of the translation function in the component's own form."""
    call = "t" if style == "react" else "$t"
    quoted = F.regexp_replace("key", r"(['\\])", r"\\$1")
    spelled = F.concat(F.lit(f"{call}('"), quoted, F.when(F.col("variables") != "", F.concat(F.lit("', { "), F.col("variables"), F.lit(" })"))).otherwise("')"))
    if style == "react":
        inline = F.concat(F.lit("{"), spelled, F.lit("}"))
        return F.when(F.col("kind") == "attribute", F.concat("attribute", F.lit("="), inline)).otherwise(inline)
    bound = F.concat(F.lit(":"), F.col("attribute"), F.lit('="'), spelled, F.lit('"'))
    return F.when(F.col("kind") == "attribute", bound).otherwise(F.concat(F.lit("{{ "), spelled, F.lit(" }}")))


def planned_edits(plan: DataFrame) -> DataFrame:
    """file (the candidate's source), id, start, end, replacement of everything that has a key; Vue files by their ending."""
    vue = F.coalesce(F.col("file_path").endswith(".vue"), F.lit(False))
    text = F.when(vue, replacement("vue")).otherwise(replacement("react"))
    return plan.where("status in ('existing', 'pending', 'duplicate')").select(F.col("cand_id").alias("file"), F.col("start").alias("id"), "start", "end", text.alias("replacement"))


def rewritten(sources: DataFrame, plan: DataFrame) -> DataFrame:
    """cand_id, text of the sources that the plan changes."""
    planned_ones = edits.planned(planned_edits(plan))
    changed = sources.select(F.col("cand_id").alias("file"), "text").join(planned_ones.select("file").distinct(), "file", "left_semi")
    return edits.applied(changed, planned_ones).select(F.col("file").alias("cand_id"), "text")


def upserted(catalog: DataFrame, plan: DataFrame, source: str = "en") -> DataFrame:
    """locale, key, value of the catalog with the pending messages added to the source locale."""
    new = plan.where("status = 'pending'").select(F.lit(source).alias("locale"), "key", F.col("text").alias("value"))
    return catalog.select("locale", "key", "value").unionByName(new)

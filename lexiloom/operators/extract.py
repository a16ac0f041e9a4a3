"""Extraction from source text with built-in expressions: references, mark-up fragments and attributes, expression classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.functions.expressions import format_placeholder
from lexiloom.functions.whitespace import trim_all

# Attributes whose value is for people.
TRANSLATABLE_ATTRIBUTES = ("alt", "aria-label", "aria-description", "caption", "helper-text", "label", "placeholder", "title", "tooltip")
# Elements without an end tag.
VOID = "area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr"
# A quoted part, which an open quote extends to the end, and a run without `+` outside of such parts.
QUOTED_PART = r"""'(?:[^'\\]|\\.)*(?:'|\\?$)|"(?:[^"\\]|\\.)*(?:"|\\?$)|`(?:[^`\\]|\\.)*(?:`|\\?$)"""
OPERAND = rf"""(?:{QUOTED_PART}|[^+'"`])+"""
LITERAL = r"""(?:'((?:[^'\\\n]|\\.)*)'|"((?:[^"\\\n]|\\.)*)")"""


def references(fragments: DataFrame, identifier: str = "t") -> DataFrame:
    """cand_id, key, pos: literal arguments of calls of the identifier itself (`t('key')`), in order of their place.

    Comments and other literals are passed over, so calls told in them don't count. For dynamic keys, templates and the
    places of calls see `calls.scanned`.
    """
    literal = r"""(?:'[^'\\\n]*'|"[^"\\\n]*")"""
    call = rf"(?<![\w$.]){identifier}\(\s*({literal})"
    other = r"""//[^\n]*|/\*.*?\*/|<!--.*?-->|'(?:[^'\\\n]|\\.)*+'|"(?:[^"\\\n]|\\.)*+\""""
    found = F.regexp_extract_all("text", F.lit(rf"(?s)(?:{other}|{call})"), F.lit(1))
    rows = fragments.where(F.col("text").contains(f"{identifier}(")).select("cand_id", F.posexplode(F.filter(found, lambda x: x != "")).alias("pos", "quoted"))
    return rows.select("cand_id", F.expr("substring(quoted, 2, length(quoted) - 2)").alias("key"), "pos")


def fallback_literals(fragments: DataFrame) -> DataFrame:
    """cand_id, key, fallback of every call with a literal second argument (`t('key', 'text')`) or a literal after `||` or `??`.

    Either quote may stand around each literal; a call with both has a row for each.
    """
    quoted = lambda inner: rf"""(?:'(?:[^'{inner}\n]++|\\.)*+'|"(?:[^"{inner}\n]++|\\.)*+")"""
    text, key = quoted(r"\\"), r"""(?:'[^'\n]*'|"[^"\n]*")"""
    call = rf"(?<![\w$.])t\(\s*{key}"
    argument = F.regexp_extract_all("text", F.lit(rf"({call}\s*,\s*{text})"), F.lit(1))
    # The alternative may follow a call whose second argument is a literal or, as one flat object or name, anything else.
    after = F.regexp_extract_all("text", F.lit(rf"({call}\s*(?:,\s*(?:{text}|[^()'\"]*+)\s*)?\)\s*(?:\|\||\?\?)\s*{text})"), F.lit(1))
    rows = fragments.where("text is not null").select("cand_id", F.explode(F.concat(argument, after)).alias("call"))
    inner = lambda c: F.expr(f"substring({c}, 2, length({c}) - 2)")
    parts = rows.select("cand_id", F.regexp_extract("call", rf"({key})", 1).alias("k"), F.regexp_extract("call", rf"({text})\z", 1).alias("f"))
    return parts.select("cand_id", inner("k").alias("key"), inner("f").alias("fallback"))


def html_fragments(documents: DataFrame, text_col: str = "text", id_col: str = "cand_id") -> DataFrame:
    """id, line_no, fragment, line by line: text between tags, after the last tag, and whole untagged lines inside mark-up.

    Of a fragment with a mustache only its quoted literals count; calls of `t` and fragments without a letter outside of
    braces are left out, and so are script and style blocks. Ids are unique: the lines of a text are ordered by its id.
    """
    lines = documents.where(F.col(text_col).contains("<")).select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "raw")).withColumn("line", F.replace("raw", F.lit("=>"), F.lit("=\x01")))
    count = lambda p: F.regexp_count("line", F.lit(p))
    opened = count(r"<[A-Za-z][\w.:-]*(?=[\s>/]|$)") - count(rf"(?i)<(?:{VOID})\b[^<>]*(?<!/)>") - count(r"/>")
    blocks = count(r"(?i)<(?:script|style)(?=[\s>]|$)") - count(r"(?i)</(?:script|style)>")
    # Whether a line ends inside a tag; null where it holds neither end of one.
    unfinished = F.when(F.col("line").rlike(r"</?[A-Za-z][^<>]*$"), True).when(F.col("line").contains(">"), False)
    of_text = Window.partitionBy(id_col).orderBy("line_no")
    before = of_text.rowsBetween(Window.unboundedPreceding, -1)
    state = lines.withColumns({"depth": opened - count(r"</[A-Za-z]"), "blocks": blocks, "unfinished": unfinished, "close": F.when(F.col("line").contains("</"), F.col("line_no"))})
    seen = state.select(
        id_col, "line_no", "raw", "line",
        (F.coalesce(F.sum("depth").over(before), F.lit(0)) > 0).alias("inside"),
        (F.sum("blocks").over(of_text) > 0).alias("blocked"),
        F.coalesce(F.last("unfinished", ignorenulls=True).over(before), F.lit(False)).alias("in_tag"),
        F.coalesce(F.max("close").over(Window.partitionBy(id_col)), F.lit(-1)).alias("last_close"),
    ).where("not blocked")
    every = lambda p: F.regexp_extract_all("line", F.lit(p), F.lit(1))
    none = F.array().cast("array<string>")
    whole = F.when(~F.col("in_tag") & F.col("inside") & (F.col("last_close") > F.col("line_no")) & ~F.col("line").contains("<"), F.array("line")).otherwise(none)
    rest = F.when(F.col("in_tag"), every(r"^[^<>]*>([^<]+)")).otherwise(none)
    between = F.regexp_extract_all("raw", F.lit(r">([^<>{}]+)<"), F.lit(1))
    texts = F.concat(between, every(r"</?[A-Za-z][^<>]*>([^<]+)"), rest, whole)
    read = F.explode(F.array_distinct(F.transform(texts, lambda t: trim_all(F.replace(t, F.lit("=\x01"), F.lit("=>"))))))
    parts = seen.select(id_col, "line_no", read.alias("part")).where(~F.col("part").rlike(r"(?:^|[^\w.])\$?t\s*\(") | F.col("part").contains("{{"))
    quoted = F.filter(F.transform(F.regexp_extract_all("part", F.lit(r"""(['"])([^"']*)\1"""), F.lit(2)), trim_all), lambda q: F.length(q) > 1)
    kept = parts.select(id_col, "line_no", F.explode(F.when(F.col("part").contains("{{"), quoted).otherwise(F.array("part"))).alias("fragment"))
    return kept.where(F.regexp_replace("fragment", r"\{[^{}]*\}", "").rlike(r"\p{L}")).distinct()


def expression_literals(expression: Column) -> Column:
    """The texts in an expression: a template without its holes, else the quoted literals, trimmed and without blank ones."""
    template = trim_all(F.regexp_replace(F.replace(expression, F.lit("`"), F.lit("")), r"\$\{[^}]*\}", ""))
    quoted = F.transform(F.regexp_extract_all(expression, F.lit(r"""('[^"']*'|"[^"']*")"""), F.lit(1)), lambda x: trim_all(x.substr(F.lit(2), F.length(x) - 2)))
    return F.filter(F.when(expression.contains("`"), F.array(template)).otherwise(quoted), lambda x: x != "")


def bound_attributes(documents: DataFrame, text_col: str = "text", id_col: str = "cand_id") -> DataFrame:
    """id, attribute, expression, literal of attributes whose value is an expression (`:title="…"`, `v-bind:title="…"`, `title={…}`)."""
    forms = (r"""\s(?:v-bind)?:([A-Za-z][\w-]*)\s*=\s*"([^"<>]*)\"""", r"""\s([A-Za-z][\w-]*)\s*=\s*\{([^{}<>]*)\}""")
    found = lambda p: F.transform(F.regexp_extract_all(text_col, F.lit(p), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, p, 1).alias("attribute"), F.regexp_extract(x, p, 2).alias("expression")))
    both = F.concat(*[found(p) for p in forms])
    rows = documents.where(F.col(text_col).contains("=")).select(id_col, F.explode(F.array_distinct(both)).alias("a")).select(id_col, "a.*")
    return rows.select(id_col, "attribute", "expression", F.explode(F.array_distinct(expression_literals(F.col("expression")))).alias("literal"))


def variable_name(c: Column, index: int = 0) -> Column:
    """An identifier itself, the last property, the singular of an indexed list (or its name and `Item`), else `varN`."""
    e = trim_all(c)
    prop, listed = F.regexp_extract(e, r"\.([A-Za-z_$][\w$]*)\z", 1), F.regexp_extract(e, r"^([A-Za-z_$][\w$]*)\[", 1)
    one = F.when(listed.endswith("s"), listed.substr(F.lit(1), F.length(listed) - 1)).otherwise(F.concat(listed, F.lit("Item")))
    return F.when(e.rlike(r"^[A-Za-z_$][\w$]*\z"), e).when(prop != "", prop).when(listed != "", one).when(e.isNotNull(), f"var{index + 1}")


def html_attributes(documents: DataFrame, text_col: str = "text", id_col: str = "cand_id") -> DataFrame:
    """id, attribute, value of all quoted attributes inside tags, with whether it's for people. Either quote may be used."""
    pairs = F.concat(*[F.regexp_extract_all(text_col, F.lit(p), F.lit(1)) for p in (r"""\s([A-Za-z][\w:-]*="[^"<>]*")""", r"""\s([A-Za-z][\w:-]*='[^'<>]*')""")])
    rows = documents.where(F.col(text_col).contains("=")).select(id_col, F.explode(F.array_distinct(pairs)).alias("pair"))
    name = F.split_part("pair", F.lit("="), F.lit(1))
    value = F.expr("substring(pair, instr(pair, '=') + 2, length(pair) - instr(pair, '=') - 2)")
    return rows.select(id_col, name.alias("attribute"), value.alias("value"), F.lower(name).isin(*TRANSLATABLE_ATTRIBUTES).alias("translatable"))


def expression_class(c: Column) -> Column:
    """What an expression is, by its text: concat, literal, template, conditional, logical or dynamic. Null for null."""
    e = trim_all(c)
    literal = r"""^(?:'[^'\n]*'|"[^"\n]*")\z"""
    return (
        F.when(e.isNull(), None)
        .when(is_concatenation(e), "concat")
        .when(e.rlike(literal), "literal")
        .when(e.rlike(r"^`[^`]*`\z"), "template")
        .when(e.rlike(r"\?[^:]+:"), "conditional")
        .when(e.rlike(r"\|\||\?\?|&&"), "logical")
        .otherwise("dynamic")
    )


def expressions(fragments: DataFrame) -> DataFrame:
    return fragments.where("text is not null").select("cand_id", expression_class(F.col("text")).alias("class"))


def templates(fragments: DataFrame) -> DataFrame:
    """cand_id, template, body of all template literals of fragments any of whose templates has a hole."""
    bodies = F.regexp_extract_all("text", F.lit(r"`([^`]*)`"), F.lit(1))
    return fragments.where("text is not null").select("cand_id", bodies.alias("bodies")).where(F.exists("bodies", lambda b: b.rlike(r"\$\{"))).select("cand_id", F.posexplode("bodies").alias("template", "body"))


def template_parts(fragments: DataFrame) -> DataFrame:
    """cand_id, template, pos, is_param, part: static and `${}` parts of all template literals of fragments with holes, in order."""
    rows = templates(fragments)
    static = F.split("body", r"\$\{[^{}]*\}", -1)
    params = F.regexp_extract_all("body", F.lit(r"\$\{([^{}]*)\}"), F.lit(1))
    both = F.flatten(F.transform(static, lambda s, i: F.filter(F.array(F.struct((i * 2).alias("pos"), F.lit(False).alias("is_param"), s.alias("part")), F.struct((i * 2 + 1).alias("pos"), F.lit(True).alias("is_param"), F.coalesce(F.get(params, i), F.lit("")).alias("part"))), lambda p: ~p["is_param"] | (i < F.size(params)))))
    return rows.select("cand_id", "template", F.explode(both).alias("p")).select("cand_id", "template", "p.pos", "p.is_param", "p.part").where("part <> '' or is_param")


def parameter_name(c: Column, index: Column | int = 0) -> Column:
    """An identifier itself, the last property of a path, the method of a call, else `argN`."""
    e = trim_all(c)
    prop, method = (F.regexp_extract(e, p, 1) for p in (r"\.([A-Za-z_$][\w$]*)\z", r"\.([A-Za-z_$][\w$]*)\s*\("))
    number = index if isinstance(index, Column) else F.lit(index)
    return F.when(e.rlike(r"^[A-Za-z_$][\w$]*\z"), e).when(prop != "", prop).when(method != "", method).otherwise(F.concat(F.lit("arg"), number.cast("string")))


def operands(expression: Column) -> Column:
    """The operands of `+` outside of quotes, trimmed; blank ones are left out. An open quote reaches to the end."""
    parts = F.regexp_extract_all(expression, F.lit(OPERAND), F.lit(0))
    return F.filter(F.transform(parts, trim_all), lambda p: p != "")


def is_concatenation(expression: Column) -> Column:
    """Whether a `+` stands outside of quotes."""
    return F.regexp_replace(expression, QUOTED_PART, "").contains("+")


def _static_text(part: Column) -> Column:
    """The text of an operand that is a literal or a template without holes; null for any other."""
    for_quotes = F.regexp_extract(part, r"""^(?:'(.+)'|"(.+)"|`([^`]*)`)\z""", 0)
    return F.when((for_quotes != "") & ~(part.startswith("`") & part.contains("${")), part.substr(F.lit(2), F.length(part) - 2))


def concatenations(fragments: DataFrame, style: str = "i18next") -> DataFrame:
    """cand_id, line_no, n_parts, n_dynamic, n_transitions, shape, class, merged of every line with a `+` outside of quotes.

    `shape` tells how literal and other operands alternate: static-prefix, dynamic-prefix, sandwich or interleaved. In
    `merged` the others are placeholders named after them; brackets that open right before one are dropped. Lines of other
    operands only are pure-dynamic and have no merged text.
    """
    lines = fragments.where("text is not null").select("cand_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    split = lines.where(F.col("line").contains("+")).where(is_concatenation(F.col("line"))).select("cand_id", "line_no", operands(F.col("line")).alias("parts"))
    told = split.withColumn("texts", F.transform("parts", _static_text))
    static = lambda i: F.get("texts", i).isNotNull()
    number = lambda i: F.size(F.filter(F.slice("texts", F.lit(1), i), lambda x: x.isNull()))
    quoted_next = lambda i: F.get("parts", i + 1).rlike("^['\"`]")
    opener = lambda x, i: F.when((i + 1 < F.size("parts")) & ~F.coalesce(quoted_next(i), F.lit(True)), F.regexp_replace(x, r"[(\[{<]+\z", "")).otherwise(x)
    piece = lambda p, i: F.when(static(i), opener(F.get("texts", i), i)).otherwise(format_placeholder(parameter_name(p, number(i)), style))
    changes = F.size(F.filter(F.transform("parts", lambda p, i: (i > 0) & (static(i) != static(i - 1))), lambda x: x))
    dynamic = F.size(F.filter("texts", lambda x: x.isNull()))
    counted = told.select("cand_id", "line_no", F.size("parts").alias("n_parts"), dynamic.alias("n_dynamic"), changes.alias("n_transitions"), static(F.lit(0)).alias("first"), static(F.size("parts") - 1).alias("last"), F.array_join(F.transform("parts", piece), "").alias("merged"))
    counted = counted.where("n_parts > 0")
    shape = F.when((F.col("n_transitions") <= 1) & F.col("first"), "static-prefix").when(F.col("n_transitions") <= 1, "dynamic-prefix").when((F.col("n_transitions") == 2) & F.col("first") & F.col("last"), "sandwich").otherwise("interleaved")
    kind = F.when(F.col("n_dynamic") == F.col("n_parts"), "pure-dynamic").when(F.col("n_dynamic") > 0, "mixed").otherwise("static")
    return counted.select("cand_id", "line_no", "n_parts", "n_dynamic", "n_transitions", shape.alias("shape"), kind.alias("class"), F.when(kind != "pure-dynamic", F.col("merged")).alias("merged"))


def template_syntax_issues(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_open, n_close, first_unexpected, n_unclosed of texts whose mustaches don't pair up.

    Read line by line: an end without a beginning is unexpected, after which the balance starts anew; `first_unexpected` is
    its line (from 1), null without one, and `n_unclosed` the balance after the last line.
    """
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    held = documents.where(F.col(text_col).contains("{{") | F.col(text_col).contains("}}"))
    # Only the lines' balances are folded.
    steps = F.transform(F.split(text_col, "\n"), lambda x: count(x, r"\{\{") - count(x, r"\}\}"))
    start = F.struct(F.lit(0).alias("line"), F.lit(0).alias("balance"), F.lit(None).cast("int").alias("first"))
    step = lambda s, d: F.struct((s["line"] + 1).alias("line"), F.greatest(s["balance"] + d, F.lit(0)).alias("balance"), F.when(s["first"].isNull() & (s["balance"] + d < 0), s["line"] + 1).otherwise(s["first"]).alias("first"))
    rows = held.select(id_col, count(text_col, r"\{\{").alias("n_open"), count(text_col, r"\}\}").alias("n_close"), F.aggregate(steps, start, step).alias("s"))
    return rows.select(id_col, "n_open", "n_close", F.col("s.first").alias("first_unexpected"), F.col("s.balance").alias("n_unclosed")).where("n_open <> n_close or first_unexpected is not null or n_unclosed > 0")


def interpolations(candidates: DataFrame) -> DataFrame:
    """cand_id, pos, name, expression, placeholder: variables of interpolated candidates with their place in the template."""
    rows = candidates.where("interpolation is not null").select("cand_id", F.posexplode("interpolation.variables").alias("pos", "v"))
    return rows.select("cand_id", "pos", "v.name", "v.expression", F.concat(F.lit("{{"), F.col("v.name"), F.lit("}}")).alias("placeholder"))

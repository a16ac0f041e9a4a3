"""SQL equivalents of the queries on source text: fragments, expressions, templates, mark-up and hashes."""

from __future__ import annotations

from lexiloom.functions import texts
from lexiloom.functions.expressions import ALLOWED_ATTRIBUTES, DENIED_ATTRIBUTES, EXPRESSION_PATTERNS, TEMPLATE_PATTERNS, TEXT_ENDINGS
from lexiloom.functions.whitespace import SPACE


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{SPACE}+|{SPACE}+$')}, '', 'g')"


def matches(x: str, pattern: str) -> str:
    options = ", 'i'" if pattern.startswith("!") else ""
    return f"regexp_matches({x}, {q(pattern.removeprefix('!'))}{options})"


def every(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


FRAGMENTS = "fr AS (SELECT cand_id, text FROM scan_candidates WHERE text IS NOT NULL)"
QUOTED = r"""'(?:[^'\\]|\\.)*(?:'|\\?$)|"(?:[^"\\]|\\.)*(?:"|\\?$)|`(?:[^`\\]|\\.)*(?:`|\\?$)"""
# Comments, calls of `t` with a literal, names with their dots, literals, anything else: the first that fits at each place.
LEXED = r"""(?s)//[^\n]*|/\*.*?\*/|<!--.*?-->|t\(\s*(?:'[^'\\\n]*'|"[^"\\\n]*")|[\w$.]+|'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|."""
HOLE = r"\$\{[^{}]*\}"
TEMPLATES = "regexp_extract_all(text, '`([^`]*)`', 1)"
LINES = "l AS (SELECT cand_id, (unnest(range(1, len(ls) + 1)) - 1)::INT line_no, unnest(ls) line FROM (SELECT cand_id, string_split(text, chr(10)) ls FROM {0}))"


def fallbacks() -> str:
    literal = r"""(?:'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*")"""
    key = r"""(?:'[^'\n]*'|"[^"\n]*")"""
    call = rf"(?:^|[^\w$.])t\(\s*{key}"
    argument = rf"{call}\s*,\s*{literal}"
    after = rf"""{call}\s*(?:,\s*(?:{literal}|[^()'"]*)\s*)?\)\s*(?:\|\||\?\?)\s*{literal}"""
    inner = lambda x: f"substring({x}, 2, length({x}) - 2)"
    return f"""WITH {FRAGMENTS}, c AS (SELECT cand_id, unnest(list_concat({every('text', argument)}, {every('text', after)})) c FROM fr),
      p AS (SELECT cand_id, regexp_extract(c, {q(key)}) k, regexp_extract(c, {q(literal + '$')}) f FROM c) SELECT cand_id, {inner('k')} AS key, {inner('f')} fallback FROM p"""


def html() -> str:
    count = lambda p: f"len({every('line', p)})"
    void = "area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr"
    depth = " - ".join((count(r"<[A-Za-z][A-Za-z0-9_.:-]*(?:[\s>/]|$)"), count(rf"(?i)<(?:{void})\b(?:[^<>]*[^<>/])?>"), count("/>"), count("</[A-Za-z]")))
    blocks = f"{count(r'(?i)<(?:script|style)(?:[\s>]|$)')} - {count(r'(?i)</(?:script|style)>')}"
    call, quoted = r"(?:^|[^\w.])\$?t\s*\(", r"""'[^'"]*'|"[^'"]*\""""
    lists = f"list_concat(list_concat({every('raw', '>([^<>{}]+)<', 1)}, {every('line', '</?[A-Za-z][^<>]*>([^<]+)', 1)}), list_concat(CASE WHEN in_tag THEN {every('line', '^[^<>]*>([^<]+)', 1)} ELSE [] END, CASE WHEN NOT in_tag AND inside AND last_close > line_no AND NOT contains(line, '<') THEN [line] ELSE [] END))"
    return f"""WITH {LINES.format("(SELECT * FROM scan_candidates WHERE contains(text, '<'))")},
      s AS (SELECT *, {depth} depth, {blocks} blocks, CASE WHEN regexp_matches(line, '</?[A-Za-z][^<>]*$') THEN true WHEN contains(line, '>') THEN false END unfinished FROM (SELECT cand_id, line_no, line raw, replace(line, '=>', '=' || chr(1)) line FROM l)),
      t AS (SELECT *, coalesce(sum(depth) OVER b, 0) > 0 inside, sum(blocks) OVER (PARTITION BY cand_id ORDER BY line_no) > 0 blocked, coalesce(last_value(unfinished IGNORE NULLS) OVER b, false) in_tag,
        coalesce(max(CASE WHEN contains(line, '</') THEN line_no END) OVER (PARTITION BY cand_id), -1) last_close FROM s WINDOW b AS (PARTITION BY cand_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      r AS (SELECT cand_id, line_no, unnest({lists}) t FROM t WHERE NOT blocked),
      p AS (SELECT DISTINCT cand_id, line_no, {trim("replace(t, '=' || chr(1), '=>')")} part FROM r),
      k AS (SELECT * FROM p WHERE contains(part, '{{{{') OR NOT regexp_matches(part, {q(call)})),
      h AS (SELECT cand_id, line_no, unnest({every('part', quoted)}) u FROM k WHERE contains(part, '{{{{')),
      f AS (SELECT cand_id, line_no, part fragment FROM k WHERE NOT contains(part, '{{{{') UNION ALL SELECT * FROM (SELECT cand_id, line_no, {trim('substring(u, 2, length(u) - 2)')} fragment FROM h) WHERE length(fragment) > 1)
      SELECT DISTINCT * FROM f WHERE regexp_matches(regexp_replace(fragment, {q(chr(92) + '{[^{}]*' + chr(92) + '}')}, '', 'g'), '\\pL')"""


def concatenations() -> str:
    prop, method = r"\.([A-Za-z_$][A-Za-z0-9_$]*)$", r"\.([A-Za-z_$][A-Za-z0-9_$]*)\s*\("
    name = f"CASE WHEN regexp_matches(p, '^[A-Za-z_$][A-Za-z0-9_$]*$') THEN p WHEN regexp_matches(p, {q(prop)}) THEN regexp_extract(p, {q(prop)}, 1) WHEN regexp_matches(p, {q(method)}) THEN regexp_extract(p, {q(method)}, 1) ELSE 'arg' || d END"
    static = r"""^(?:'.+'|".+"|`[^`]*`)$"""
    part = rf"""(?s)(?:{QUOTED}|[^+'"`])+"""
    return f"""WITH {FRAGMENTS}, {LINES.format('fr')},
      s AS (SELECT cand_id, line_no, list_filter(list_transform({every('line', part)}, lambda x: {trim('x')}), lambda x: x <> '') ps FROM l WHERE contains(regexp_replace(line, {q('(?s)' + QUOTED)}, '', 'g'), '+')),
      e AS (SELECT cand_id, line_no, len(ps) n, unnest(range(1, len(ps) + 1)) i, unnest(ps) p FROM s),
      k AS (SELECT *, regexp_matches(p, {q(static)}) AND NOT (starts_with(p, '`') AND contains(p, '${{')) st FROM e),
      o AS (SELECT *, lag(st) OVER w <> st AS changes, lead(NOT regexp_matches(p, '^[''"`]')) OVER w AS opens, (sum(CASE WHEN st THEN 0 ELSE 1 END) OVER w - 1)::INT d FROM k WINDOW w AS (PARTITION BY cand_id, line_no ORDER BY i)),
      m AS (SELECT *, CASE WHEN st AND coalesce(opens, false) THEN regexp_replace(substring(p, 2, length(p) - 2), '[(\\[{{<]+$', '') WHEN st THEN substring(p, 2, length(p) - 2) ELSE '{{{{' || {name} || '}}}}' END piece FROM o),
      g AS (SELECT cand_id, line_no, any_value(n)::INT n_parts, (count(*) FILTER (WHERE NOT st))::INT n_dynamic, (count(*) FILTER (WHERE changes))::INT n_transitions, bool_or(st AND i = 1) f, bool_or(st AND i = n) z, string_agg(piece, '' ORDER BY i) merged FROM m GROUP BY 1, 2)
      SELECT cand_id, line_no, n_parts, n_dynamic, n_transitions, CASE WHEN n_transitions <= 1 AND f THEN 'static-prefix' WHEN n_transitions <= 1 THEN 'dynamic-prefix' WHEN n_transitions = 2 AND f AND z THEN 'sandwich' ELSE 'interleaved' END shape,
        CASE WHEN n_dynamic = n_parts THEN 'pure-dynamic' WHEN n_dynamic > 0 THEN 'mixed' ELSE 'static' END "class", CASE WHEN n_dynamic < n_parts THEN merged END merged FROM g"""


def decoded(x: str) -> str:
    code = "CASE WHEN regexp_matches(e, '^&#[xX]') THEN ('0x' || regexp_extract(e, '^&#[xX]([0-9a-fA-F]+);', 1))::INT ELSE regexp_extract(e, '^&#([0-9]+);', 1)::INT END"
    numbers = f"list_distinct({every(x, '&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});')})"
    out = f"list_reduce(list_concat([{x}], {numbers}), lambda acc, e: replace(acc, e, chr({code})))"
    for name, sign in texts.ENTITIES:
        out = f"replace({out}, {q(name)}, {q(sign)})"
    return out


ATTRIBUTES = r"""a AS (SELECT cand_id, split_part(p, '=', 1) attribute, substring(p, strpos(p, '=') + 2, length(p) - strpos(p, '=') - 2) AS v FROM (SELECT cand_id, unnest(list_distinct(list_concat(regexp_extract_all(text, '\s([A-Za-z][\w:-]*="[^"<>]*")', 1), regexp_extract_all(text, '\s([A-Za-z][\w:-]*=''[^''<>]*'')', 1)))) p FROM scan_candidates))"""


def oracle_sql() -> dict[str, str]:
    reasons = "CASE " + " ".join(f"WHEN {matches('text' if whole else 't', p)} THEN '{r}'" for r, whole, p in EXPRESSION_PATTERNS) + " END"
    templates = "CASE " + " ".join(f"WHEN {matches('text', p)} THEN '{r}'" for r, p in TEMPLATE_PATTERNS) + " END"
    listed = lambda xs: "(" + ", ".join(q(x) for x in xs) + ")"
    endings = " OR ".join(f"ends_with(lower(attribute), '{e}')" for e in TEXT_ENDINGS)
    units = "list_transform(string_split(text, ''), lambda c: CASE WHEN c = '' THEN [0] WHEN unicode(c) > 65535 THEN [55296 + ((unicode(c) - 65536) >> 10), 56320 + (unicode(c) - 65536) % 1024] ELSE [unicode(c)] END)"
    holed = rf"b AS (SELECT cand_id, (unnest(range(1, len(bs) + 1)) - 1)::INT template, unnest(bs) body FROM (SELECT cand_id, {TEMPLATES} bs FROM fr) WHERE len(list_filter(bs, lambda b: contains(b, '${{'))) > 0)"
    parts = f"""c AS (SELECT cand_id, template, regexp_split_to_array(body, {q(HOLE)}) st, {every('body', HOLE)} ho FROM b),
      tp AS (SELECT * FROM (SELECT cand_id, template, ((unnest(range(1, len(st) + 1)) - 1) * 2)::INT pos, false is_param, unnest(st) part FROM c) WHERE part <> ''
        UNION ALL SELECT cand_id, template, pos, true, substring(p, 3, length(p) - 3) FROM (SELECT cand_id, template, (unnest(range(1, len(ho) + 1)) * 2 - 1)::INT pos, unnest(ho) p FROM c))"""
    star, dot = r"\*+", r"\.+"
    words = "(?is)" + texts.SQL_WORDS
    return {
        "html_fragments": html(),
        "fallback_literals": fallbacks(),
        "concat_split": concatenations(),
        "expression_reasons": f"SELECT * FROM (SELECT cand_id, {reasons} reason, {templates} template_reason FROM (SELECT cand_id, text, {trim('text')} t FROM scan_candidates WHERE text IS NOT NULL)) WHERE reason IS NOT NULL OR template_reason IS NOT NULL",
        "sql_prefix": f"""SELECT cand_id, prefix FROM (SELECT cand_id, text, CASE WHEN w <> '' AND (w = upper(w) OR regexp_matches(text, '[=*''"]')) THEN regexp_replace(regexp_extract(text, {q('(?is)^(.*?)' + texts.SQL_WORDS)}, 1), {q(SPACE + '+$')}, '') ELSE text END prefix
          FROM (SELECT cand_id, text, regexp_extract(text, {q(words)}, 1) w FROM scan_candidates WHERE text IS NOT NULL)) WHERE prefix <> text""",
        "text_hash": f"""SELECT cand_id, lower(to_base(CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END, 36)) AS hash FROM (SELECT cand_id,
          list_reduce(list_concat([0::BIGINT], list_transform(flatten({units}), lambda c: c::BIGINT)), lambda a, c: (a * 31 + c) & 4294967295) h FROM scan_candidates WHERE text IS NOT NULL)""",
        "vue_expr_class": rf"""WITH {FRAGMENTS} SELECT cand_id, CASE WHEN contains(regexp_replace(e, {q('(?s)' + QUOTED)}, '', 'g'), '+') THEN 'concat' WHEN regexp_matches(e, '^(''[^''\n]*''|"[^"\n]*")$') THEN 'literal'
          WHEN regexp_matches(e, '^`[^`]*`$') THEN 'template' WHEN regexp_matches(e, '\?[^:]+:') THEN 'conditional' WHEN regexp_matches(e, '\|\||\?\?|&&') THEN 'logical' ELSE 'dynamic' END "class" FROM (SELECT cand_id, {trim('text')} e FROM fr)""",
        "source_references": rf"""WITH {FRAGMENTS}, k AS (SELECT cand_id, list_filter({every('text', LEXED)}, lambda x: regexp_matches(x, '^t\(\s*[''"]')) ts FROM fr), u AS (SELECT cand_id, (unnest(range(1, len(ts) + 1)) - 1)::INT pos, unnest(ts) t FROM k)
          SELECT cand_id, pos, regexp_extract(t, '^t\(\s*[''"](.*).$', 1) AS key FROM u""",
        "template_split": f"WITH {FRAGMENTS}, {holed}, {parts} SELECT cand_id, template, pos, is_param, part FROM tp",
        "assumed_patterns": f"WITH {FRAGMENTS}, {holed} SELECT cand_id, template, regexp_replace(regexp_replace(regexp_replace({trim('''split_part(body, '||', 1)''')}, {q(HOLE)}, '*', 'g'), {q(star)}, '*', 'g'), {q(dot)}, '.', 'g') AS pattern FROM b WHERE contains(body, '${{')",
        "html_decode": f"SELECT cand_id, {decoded('text')} decoded FROM scan_candidates WHERE text IS NOT NULL",
        "attribute_rules": f"WITH {ATTRIBUTES} SELECT DISTINCT attribute, lower(attribute) NOT IN {listed(DENIED_ATTRIBUTES)} AND (lower(attribute) IN {listed(ALLOWED_ATTRIBUTES)} OR {endings}) translatable FROM a",
    }

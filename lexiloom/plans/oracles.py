"""SQL equivalents of the registered queries, in DuckDB's dialect. Written on their own; only fixed values are shared."""

from __future__ import annotations

from lexiloom.functions import keys, texts
from lexiloom.functions.placeholders import NAMED
from lexiloom.functions.whitespace import SPACE
from lexiloom.operators.quality import ABBREVIATIONS
from lexiloom.operators.rejects import SPREADSHEET_ERRORS
from lexiloom.operators.sync import EMPTY_MARKERS
from lexiloom.plans import oracles_source


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{SPACE}+|{SPACE}+$')}, '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(f'{SPACE}+')}, ' ', 'g'))"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {trim(x)} = '')"


def any_of(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def matches(x: str, pattern: str) -> str:
    """A rule's pattern, whose case mark becomes an option."""
    options = ", 'i'" if pattern.startswith("!") else ""
    return f"regexp_matches({x}, {q(pattern.removeprefix('!'))}{options})"


CATALOG = "cat AS (SELECT locale, key, value, ord FROM (SELECT *, row_number() OVER (PARTITION BY locale, key ORDER BY ord DESC) rn FROM locale_catalog) WHERE rn = 1)"
BY_TEXT = "(SELECT locale, key, value, ord FROM locale_catalog UNION ALL SELECT 'en', replace(lower(text), ' ', '-'), text, cand_id FROM scan_candidates WHERE length(text) < 30 AND NOT contains(text, '.'))"
HANDED = "(SELECT target_locale locale, key, translated_value AS value, row_id ord FROM csv_rows WHERE target_locale IS NOT NULL AND translated_value IS NOT NULL)"
KEYS = "ks AS (SELECT key FROM locale_catalog UNION SELECT key FROM refs UNION SELECT key FROM csv_rows UNION SELECT suggested_key FROM scan_candidates WHERE suggested_key IS NOT NULL)"
RBK = "rbk AS (SELECT key, count(*) n_references, arg_min(file_path, ord) first_file, arg_min(line, ord) first_line, arg_min(fallback_literal, ord) FILTER (WHERE fallback_literal IS NOT NULL) fallback FROM refs GROUP BY key)"
SRC = "src AS (SELECT key, value FROM cat WHERE locale = 'en')"
LAST = "list_extract(string_split(key, '.'), -1)"


def suspicion(k: str) -> str:
    tail = f"list_extract(string_split({k}, '.'), -1)"
    humps = f"regexp_extract_all({tail}, '[A-Z][^A-Z]*|^[^A-Z]+')"
    return f"""CASE WHEN contains({k}, ' ') THEN 'contains-spaces'
      WHEN regexp_matches({k}, '^[A-Za-z]+$') THEN 'single-word-no-namespace'
      WHEN regexp_matches({k}, '[:?!]$') THEN 'trailing-punctuation'
      WHEN regexp_matches({tail}, '([A-Z][a-z]+){{3}}') AND NOT regexp_matches({tail}, '[-_]') AND len({humps}) >= 4 AND len(list_filter({humps}, lambda w: len(w) <= 1)) = 0 THEN 'pascal-case-sentence'
      WHEN regexp_matches({tail}, '(^|[a-z])({"|".join(keys.SENTENCE_WORDS)})([A-Z]|$)') THEN 'sentence-article' END"""


def words(x: str) -> str:
    spaced = f"""regexp_replace({x}, '[:?!,.;''"]+', ' ', 'g')"""
    humps = rf"regexp_replace(regexp_replace({spaced}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"
    return f"list_filter(string_split(lower({collapse(humps)}), ' '), lambda w: w <> '')"


def normalized(k: str, sign: str) -> str:
    clean = f"regexp_matches({k}, '^[a-zA-Z0-9._-]+\\.[^.]+$')"
    space = f"CASE WHEN {clean} THEN regexp_extract({k}, '^(.*)\\.[^.]+$', 1) ELSE 'common' END"
    part = f"CASE WHEN {clean} THEN list_extract(string_split({k}, '.'), -1) ELSE {k} END"
    w = words(f"({part})")
    return f"({space}) || '.' || CASE WHEN len({w}) = 0 THEN 'unknown' ELSE array_to_string(list_slice({w}, 1, 4), '{sign}') END"


def tokens(x: str) -> str:
    named = [f"regexp_extract_all({x}, {q(p)}, 1)" for p in NAMED.values()]
    positional = f"list_transform(range(len(regexp_extract_all({x}, '%s'))), lambda i: '__positional__' || (i + 1))"
    return f"list_concat(list_concat({named[0]}, {named[1]}), {positional})"


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


def empty_reason(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'null' WHEN {x} = '' THEN 'empty' WHEN {trim(x)} = '' THEN 'whitespace' WHEN lower({trim(x)}) IN {any_of(EMPTY_MARKERS)} THEN 'placeholder' END"


MEANINGFUL = "({0} IS NOT NULL AND {1} IS NULL)"


def meaningful(x: str) -> str:
    return f"({x} IS NOT NULL AND ({empty_reason(x)}) IS NULL)"


def skip_reason(rows: str = "(SELECT cand_id, text, NULL::VARCHAR attribute FROM scan_candidates)") -> str:
    t = trim("text")
    n = "len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> ''))"
    signals = " + ".join(f"regexp_matches(t, {q(p)})::int" for p in texts.UTILITY_SIGNALS)
    arbitrary = r"regexp_matches(t, '\[[\d.]+\]')"
    like = f"(regexp_matches(t, {q(texts.CLASS_LIST)}) AND len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: regexp_matches(x, '[-/\\[]|:\\w|\\d'))) > 0)"
    some = f"(({signals}) >= 1 OR {arbitrary})"
    listed = f"CASE WHEN {like} AND {n} >= 3 THEN true WHEN {like} AND {n} = 2 THEN {some} WHEN {n} < 2 THEN {like} AND {some} ELSE {some} END"
    prefixes = "|".join(texts.UTILITY_PREFIXES)
    single = f"(NOT contains(t, ' ') AND regexp_matches(t, '^({prefixes})[-]?\\d*[a-z0-9./\\[\\]-]*$', 'i') AND (regexp_matches(t, '\\d') OR regexp_matches(t, '^({prefixes})')))"
    rules = lambda rs: "\n".join(f"WHEN {matches('t', p)} THEN '{r}'" for r, p in rs)
    return f"""SELECT cand_id, text, t, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN length(text) = 1 THEN 'single-character'
      {rules(texts.FILTER_RULES_BEFORE_CLASSES)} WHEN {listed} THEN 'non_sentence' {rules(texts.FILTER_RULES_AFTER_CLASSES)}
      WHEN length(t) > 1 AND t = repeat(left(t, 1), length(t)) AND regexp_matches(left(t, 1), '[^\\pL\\d\\s]') THEN 'repeated-symbols'
      WHEN lower(attribute) = 'type' AND lower(t) IN {any_of(texts.HTML_TYPES)} THEN 'html-type-keyword' WHEN lower(t) IN {any_of(texts.CSS_VALUES)} THEN 'css-value-keyword' {rules(texts.FILTER_RULES_LAST)}
      WHEN {single} THEN 'single-token-tailwind' WHEN NOT regexp_matches(t, '\\pL') THEN 'no-letters'
      WHEN lower(attribute) IN {any_of(texts.OPAQUE_ATTRIBUTES)} OR attribute IS NOT NULL AND {matches('t', texts.CSS_KEYWORD)} OR lower(attribute) IN ('type', 'inputmode') AND {matches('t', texts.INPUT_TYPE)}
        OR lower(attribute) IN ('icon', 'iconname', 'icon-name') AND {matches('t', texts.ICON)} OR lower(attribute) IN ('href', 'to', 'action', 'src') AND {matches('t', texts.RELATIVE_PATH)} THEN 'non_sentence' END reason, {listed} is_list, attribute
      FROM (SELECT cand_id, text, {t} t, attribute FROM {rows})"""


def missing(source: str = "refs", extra: str = "") -> str:
    """Keys in use that the source catalog lacks or holds blank."""
    r = RBK.replace("FROM refs", f"FROM {source}")
    return f"""{CATALOG}, {SRC}, {extra}{r}, mk AS (SELECT r.key, n_references, first_file, first_line, fallback, {suspicion('r.key')} suspicion
      FROM rbk r LEFT JOIN src s ON r.key = s.key WHERE {blank('s.value')})"""


UNUSED = f"""un AS (SELECT c.*, c.locale <> 'en' AND {blank('c.value')} AND NOT {blank('s.value')} AS untranslated FROM cat c LEFT JOIN src s ON c.key = s.key
  WHERE c.key NOT IN (SELECT key FROM refs))"""
PAIRS = "pairs AS (SELECT t.key, t.locale, s.value sv, t.value tv FROM cat t JOIN src s ON t.key = s.key WHERE t.locale <> 'en')"
ISSUES = f"""iss AS (SELECT key, locale, list_sort(list_filter(list_distinct({tokens('sv')}), lambda x: NOT list_contains({tokens('tv')}, x))) gone,
  list_sort(list_filter(list_distinct({tokens('tv')}), lambda x: NOT list_contains({tokens('sv')}, x))) extra FROM pairs)"""
SCOPED = "scoped AS (SELECT * FROM refs WHERE file_path LIKE '%.vue'), "
GAPS = "gaps AS (SELECT l.locale, k.key FROM (SELECT DISTINCT locale FROM cat) l, (SELECT DISTINCT key FROM cat) k WHERE NOT EXISTS (SELECT 1 FROM cat c WHERE c.locale = l.locale AND c.key = k.key))"
PATTERN_ROWS = """ex AS (SELECT DISTINCT pattern, replace(pattern, '*', v) key FROM (SELECT pattern, unnest(vs) v FROM (VALUES ('settings.*.label', ['upload', 'share', 'retry']),
  ('auth.*', ['title', 'error.note']), ('common.save', []::VARCHAR[]), ('common.cancel', ['now', 'later'])) p(pattern, vs)))"""
EDITS = "ed AS (SELECT l_orderkey file, (l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey)::BIGINT id, (l_linenumber * 10)::BIGINT s, (l_linenumber * 10 + max(l_quantity))::BIGINT e, max(l_returnflag) r FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey)"
LENT = f"""lent AS (SELECT key, locale, lender reused_from, lent reused FROM (SELECT r.key, r.locale, c.locale lender, c.value lent,
  row_number() OVER (PARTITION BY r.key, r.locale ORDER BY (c.locale = split_part(c.locale, '-', 1))::int, c.locale) rn
  FROM (SELECT k.key, l.locale FROM (SELECT DISTINCT key FROM cat) k, (SELECT DISTINCT locale FROM cat WHERE contains(locale, '-')) l) r
  JOIN cat c ON c.key = r.key AND split_part(c.locale, '-', 1) = split_part(r.locale, '-', 1) AND c.locale <> r.locale WHERE {meaningful('c.value')}) WHERE rn = 1)"""
PLAN = f"""plan AS (SELECT s.key, l.locale, s.value source_value, t.value existing, lent.reused_from, lent.reused, len({ordered_distinct(tokens('s.value'))})::INT n_placeholders
  FROM src s CROSS JOIN (SELECT DISTINCT locale FROM cat WHERE locale <> 'en') l LEFT JOIN cat t ON t.key = s.key AND t.locale = l.locale
  LEFT JOIN lent ON lent.key = s.key AND lent.locale = l.locale WHERE NOT {blank('s.value')} AND NOT {meaningful('t.value')})"""
ACTIONS = f"""act AS (SELECT u.key, u.locale, CASE WHEN {blank('u.new')} THEN 'skip-empty' WHEN c.value = u.new THEN 'unchanged' WHEN {meaningful('c.value')} THEN 'skip-existing' ELSE 'write' END action
  FROM (SELECT key, target_locale locale, max(translated_value) new FROM csv_rows WHERE key IS NOT NULL AND target_locale IS NOT NULL GROUP BY ALL) u LEFT JOIN cat c ON c.key = u.key AND c.locale = u.locale)"""
FRAGMENTS = "fr AS (SELECT cand_id, text FROM scan_candidates WHERE text IS NOT NULL)"
DUPLICATES = f"dup AS (SELECT locale, lower({trim('value')}) folded, count(*) n_keys, arg_min(value, ord) AS v, min(key) first_key FROM cat WHERE length(value) >= 3 GROUP BY ALL HAVING count(*) > 1)"
ITEMS = f"""{missing()}, {UNUSED}, {PAIRS}, {ISSUES}, items AS (
  SELECT 'missing-key' kind, CASE WHEN fallback IS NOT NULL THEN 'warn' ELSE 'error' END severity, key, NULL::VARCHAR locale FROM mk
  UNION ALL SELECT DISTINCT 'unused-key', 'warn', key, NULL FROM un WHERE NOT untranslated
  UNION ALL SELECT 'placeholder-mismatch', 'error', key, locale FROM iss WHERE len(gone) > 0 OR len(extra) > 0
  UNION ALL SELECT 'empty-value', 'warn', key, locale FROM cat WHERE locale <> 'en' AND ({empty_reason('value')}) IS NOT NULL
  UNION ALL SELECT DISTINCT 'suspicious-key', 'warn', key, NULL FROM refs WHERE ({suspicion('key')}) IS NOT NULL)"""


# The catalog after adding what is missing, dropping what is unused, and seeding the other locales.
VALUE_OF = "coalesce(fallback, recovered, nullif(made, ''), key)"


def applied(value_words: str) -> str:
    made = f"array_to_string(list_filter(ws, lambda w, i: i = 1 OR lower(ws[i - 1]) <> lower(w)), ' ')"
    return f"""{missing()}, {UNUSED}, rec AS (SELECT key, recovered FROM (SELECT m.key, u.value recovered, row_number() OVER (PARTITION BY m.key ORDER BY length(u.key) DESC, u.key DESC) rn
      FROM mk m JOIN un u ON u.locale = 'en' AND u.value <> '' AND u.key <> m.key AND contains('.' || m.key || '.', '.' || u.key || '.')) WHERE rn = 1),
      wd AS (SELECT key, list_transform({value_words}, lambda w: CASE WHEN len(w) > 1 AND w = upper(w) THEN w ELSE upper(w[1]) || lower(w[2:]) END) ws FROM mk),
      new AS (SELECT 'en' locale, mk.key, {VALUE_OF} AS value FROM mk LEFT JOIN rec USING (key) JOIN (SELECT key, {made} made FROM wd) USING (key)),
      merged AS (SELECT locale, key, value FROM cat c WHERE NOT EXISTS (SELECT 1 FROM un u WHERE u.locale = c.locale AND u.key = c.key AND NOT u.untranslated) AND (locale, key) NOT IN (SELECT (locale, key) FROM new)
        UNION ALL SELECT * FROM new),
      done AS (SELECT * FROM merged UNION ALL SELECT l.locale, m.key, '' FROM (SELECT DISTINCT locale FROM merged WHERE locale <> 'en') l, (SELECT key FROM merged WHERE locale = 'en') m
        WHERE NOT EXISTS (SELECT 1 FROM merged x WHERE x.locale = l.locale AND x.key = m.key))"""


def mapping() -> str:
    fix = f"CASE reason WHEN 'single-word-no-namespace' THEN 'common.' || lower(key) WHEN 'trailing-punctuation' THEN regexp_replace(key, '[:?!]+$', '') ELSE {normalized('key', '-')} END"
    return f"""{CATALOG}, named AS (SELECT DISTINCT key, {suspicion('key')} reason FROM refs WHERE key IS NOT NULL),
      mp AS (SELECT key from_key, {fix} to_key FROM named WHERE reason IS NOT NULL UNION SELECT key, replace(key, '_', '-') FROM cat WHERE contains(key, '_'))"""


def generated(style: str) -> str:
    safe = collapse(rf"regexp_replace(regexp_replace({trim('text')}, '[(\[{{<]+\s*$', ''), '^\s*[)\]}}>]+', '')")
    low = f"lower({safe})"
    if style == "camel":
        parts = f"regexp_split_to_array({low}, '[^a-z0-9]+')"
        made = f"array_to_string(list_transform({parts}, lambda w, i: CASE WHEN i = 1 OR w = '' THEN w ELSE upper(w[1]) || w[2:] END), '')"
        made = f"(lower(({made})[1]) || ({made})[2:])"
    else:
        sign = "_" if style == "snake" else "-"
        made = f"regexp_replace(regexp_replace({low}, '[^a-z0-9]+', '{sign}', 'g'), '^{sign}+|{sign}+$', '', 'g')"
    return f"SELECT cand_id, substring({made}, 1, 50) made FROM scan_candidates WHERE text IS NOT NULL"


def slug(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace(regexp_replace({x}, '[<>{{}}]', '', 'g'), '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'))"


DIGEST = f"substring(sha1({collapse('text')} || '|' || kind || '|' || coalesce(context, '') || '|'), 1, 6)"


def p3(out: str = "SELECT line_id, reason FROM r WHERE reason IS NOT NULL") -> str:
    bad_text = "[\\x{FFFD}\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{7F}-\\x{9F}]"
    field = lambda n: f"""(CASE WHEN list_position(names, '{n}') > 0 THEN list_extract(fields, list_position(names, '{n}')) END)"""
    split = r"""regexp_extract_all(d || rec, '(?s)' || d || '("(?:[^"]|"")*"|[^"' || d || ']*)', 1)"""
    whole = r"""regexp_full_match(rec, '(?s)("([^"]|"")*"|[^"' || d || ']|' || 'X'[1:0] || '[^"' || d || '][^"' || d || ']*)?(' || d || '("([^"]|"")*"|[^"' || d || ']*))*')"""
    unquote = """list_transform({0}, lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END)"""
    return f"""WITH h AS (SELECT file_name, regexp_replace(rtrim_cr, '^\\x{{FEFF}}', '') raw FROM (SELECT file_name, regexp_replace(arg_min(raw, line_id), '\\r$', '') rtrim_cr FROM csv_lines WHERE line_no = 1 AND raw IS NOT NULL GROUP BY file_name)),
      hd AS (SELECT file_name, raw, CASE WHEN contains(raw, chr(9)) THEN chr(9) WHEN contains(raw, ';') THEN ';' ELSE ',' END d FROM h),
      hn AS (SELECT file_name, d, list_transform(string_split(raw, d), lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')) names FROM hd),
      b AS (SELECT line_id, file_name, line_no, regexp_replace(raw, '\\r$', '') rec, d, names FROM csv_lines JOIN hn USING (file_name) WHERE line_no <> 1 AND NOT {blank('raw')}),
      f AS (SELECT line_id, file_name, line_no, names, {whole} ok, {unquote.format(split)} fields FROM b),
      v AS (SELECT line_id, file_name, line_no, {field('sourcevalue')} sv, ok, len(fields) = len(names) counted, {trim(field('key'))} k, lower(replace({trim(field('targetlocale'))}, '_', '-')) loc, {field('translatedvalue')} tv FROM f),
      r AS (SELECT *, CASE WHEN NOT ok THEN 'quoting' WHEN NOT counted THEN 'column_count' WHEN NOT regexp_full_match(k, '[A-Za-z0-9_-]+(\\.[A-Za-z0-9_-]+)*') OR loc NOT IN (SELECT lower(locale) FROM locales)
        OR regexp_matches(tv, '{bad_text}') OR {trim('tv')} IN {any_of(SPREADSHEET_ERRORS)} THEN 'invalid_value' END reason FROM v)
      {out}"""


def oracle_sql() -> dict[str, str]:
    by_key = lambda e: f"WITH {KEYS} SELECT key, {e} FROM ks"
    conv = lambda p: f"regexp_matches({LAST}, '{p}')"
    hash_segment = "regexp_matches(s, '^[0-9a-fA-F]+$') AND len(s) IN (4, 6, 8, 12, 16, 32, 40, 64)"
    plain = f"list_filter(string_split(key, '.'), lambda s: NOT ({hash_segment}))"
    base = f"CASE WHEN len({plain}) > 0 THEN list_extract({plain}, -1) ELSE {LAST} END"
    value_words = rf"""list_filter(string_split({collapse(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({base}, '[._/-]+', ' ', 'g'), '([a-z0-9])([A-Z])', '{chr(92)}1 {chr(92)}2', 'g'), '([A-Z]+)([A-Z][a-z])', '{chr(92)}1 {chr(92)}2', 'g'), '[^a-zA-Z0-9 ]+', ' ', 'g')")}, ' '), lambda w: w <> '')"""
    naming = f"CASE WHEN NOT regexp_matches({LAST}, '[a-zA-Z]') THEN 'none' WHEN contains({LAST}, '-') THEN 'kebab' WHEN contains({LAST}, '_') THEN 'snake' WHEN regexp_matches({LAST}, '[a-z][A-Z]') THEN 'camel' ELSE 'neutral' END"
    sure = [p for p in texts.PATTERNS if p[2] >= 0.8]
    case = lambda i: "CASE " + " ".join(f"WHEN {matches('text', p[3])} THEN {q(p[i]) if isinstance(p[i], str) else f'{p[i]}::DOUBLE'}" for p in sure) + " END"
    ranked = sorted(texts.PATTERNS, key=lambda p: -p[2])
    all_patterns = "concat_ws(',', " + ", ".join(f"CASE WHEN {matches('text', p[3])} THEN {q(p[0])} END" for p in ranked) + ")"
    letters = "len(regexp_extract_all(text, '\\pL'))"
    rated = f"CASE WHEN {letters} < 2 THEN 0.0 WHEN {letters} / length(text) < 0.25 THEN 0.2 WHEN {letters} >= 5 THEN 0.9 WHEN {letters} / length(text) >= 0.6 THEN 0.85 WHEN {letters} >= 4 THEN 0.8 ELSE 0.6 END"
    scope = f"list_filter(list_transform(string_split(regexp_replace(file_path, '\\.[^/.]+$', ''), '/'), lambda s: {slug('s')}), lambda s, i: s <> '' AND s <> 'index' AND NOT (i = 1 AND s = 'src'))"
    four = f"array_to_string(list_slice(list_filter(string_split({slug(collapse('text'))}, '-'), lambda w: w <> ''), 1, 4), '-')"
    fixed = ".replace"
    return oracles_source.oracle_sql() | {
        "p3_found": p3(),
        "p3_loaded": p3("SELECT line_id, file_name, line_no, k AS key, sv AS source_value, (SELECT min(locale) FROM locales WHERE lower(replace(locale, '_', '-')) = loc) target_locale, tv AS translated_value FROM r WHERE reason IS NULL"),
        "suspicious_keys": f"SELECT * FROM ({by_key(suspicion('key') + ' reason')}) WHERE reason IS NOT NULL",
        "key_format": by_key("regexp_matches(key, '^[a-zA-Z0-9._-]+$') valid"),
        "convention_check": by_key(f"{conv(keys.CONVENTIONS['kebab-case'])} kebab, {conv(keys.CONVENTIONS['snake_case'])} snake, {conv(keys.CONVENTIONS['camelCase'])} camel"),
        "normalize_to_key": by_key(f"{normalized('key', '-')} kebab, {normalized('key', '_')} snake"),
        "suggest_fix": f"""SELECT key, CASE reason WHEN 'single-word-no-namespace' THEN 'common.' || lower(key) WHEN 'trailing-punctuation' THEN regexp_replace(key, '[:?!]+$', '') ELSE {normalized('key', '-')} END fix
          FROM ({by_key(suspicion('key') + ' reason')}) WHERE reason IS NOT NULL""",
        "value_from_key": f"""WITH {KEYS}, w AS (SELECT key, list_transform({value_words}, lambda w: CASE WHEN len(w) > 1 AND w = upper(w) THEN w ELSE upper(w[1]) || lower(w[2:]) END) ws FROM ks)
          SELECT key, array_to_string(list_filter(ws, lambda w, i: i = 1 OR lower(ws[i - 1]) <> lower(w)), ' ') AS value FROM w""",
        "generate_key_snake": generated("snake"),
        "generate_key_kebab": generated("kebab"),
        "generate_key_camel": generated("camel"),
        "key_digest": f"SELECT cand_id, {DIGEST} digest FROM scan_candidates WHERE text IS NOT NULL",
        "key_full": f"""SELECT cand_id, concat_ws('.', 'app', nullif(array_to_string(list_slice({scope}, -4, -1), '.'), ''), nullif({slug('context')}, ''), nullif({four}, ''), {DIGEST}) made FROM scan_candidates WHERE text IS NOT NULL""",
        "naming_votes": f"WITH {CATALOG} SELECT locale, " + ", ".join(f"count(*) FILTER (WHERE {naming} = '{f}') n_{f}" for f in ("kebab", "camel", "snake", "neutral")) + " FROM cat GROUP BY locale",
        "text_filter": f"SELECT cand_id, reason FROM ({skip_reason()})",
        "text_filter_attributes": f"WITH {oracles_source.ATTRIBUTES} SELECT cand_id, attribute, text AS value, reason FROM ({skip_reason('(SELECT cand_id, v AS text, attribute FROM a)')})",
        "css_class_list": f"SELECT cand_id, is_list FROM (SELECT cand_id, is_list FROM ({skip_reason().replace(trim('text') + ' t', 'text t')}) WHERE text IS NOT NULL)",
        "pattern_detect": f"SELECT * FROM (SELECT cand_id, {case(0)} pattern, {case(1)} category, {case(2)} confidence FROM scan_candidates WHERE text IS NOT NULL) WHERE pattern IS NOT NULL",
        "pattern_detect_all": f"SELECT * FROM (SELECT cand_id, {all_patterns} patterns FROM scan_candidates WHERE text IS NOT NULL) WHERE patterns <> ''",
        "confidence_bucket": f"""SELECT cand_id, CASE WHEN skip_reason IS NOT NULL THEN 'skip' WHEN coalesce(forced, false) THEN 'review' WHEN r < 0.5 THEN 'skip' WHEN r >= 0.8 THEN 'high' ELSE 'review' END bucket,
          CASE WHEN skip_reason IS NOT NULL THEN 0.0 WHEN coalesce(forced, false) THEN 0.5 ELSE r END::DOUBLE score FROM (SELECT *, {rated} r FROM scan_candidates WHERE text IS NOT NULL)""",
        "skip_reason_topk": f"SELECT reason, count(*) n FROM ({skip_reason()}) WHERE reason IS NOT NULL GROUP BY reason ORDER BY n DESC, reason LIMIT 5",
        "pseudo_localize": f"WITH {CATALOG} SELECT locale, key, '[' || locale || '] ' || translate(value, {q(texts.ACCENTS[0])}, {q(texts.ACCENTS[1])}) pseudo FROM cat",
        "extract_placeholders": f"WITH {CATALOG} SELECT locale, key, array_to_string({ordered_distinct(tokens('value'))}, ',') tokens FROM cat",
        "placeholder_issues": f"WITH {CATALOG}, {SRC}, {PAIRS}, {ISSUES} SELECT key, locale, array_to_string(gone, ',') missing, array_to_string(extra, ',') extra FROM iss WHERE len(gone) > 0 OR len(extra) > 0",
        "csv_placeholder_checks": f"SELECT row_id, array_to_string(gone, ',') missing FROM (SELECT row_id, list_sort(list_filter(list_distinct({tokens('source_value')}), lambda x: NOT list_contains({tokens('translated_value')}, x))) gone FROM csv_rows WHERE source_value IS NOT NULL AND translated_value IS NOT NULL) WHERE len(gone) > 0",
        "catalog": f"WITH {CATALOG} SELECT * FROM cat",
        "references_by_key": f"WITH {RBK} SELECT * FROM rbk",
        "missing_keys": f"WITH {missing()} SELECT * FROM mk",
        "unused_keys": f"WITH {CATALOG}, {SRC}, {UNUSED} SELECT key, string_agg(locale, ',' ORDER BY locale) locales, count(*) n_locales FROM un WHERE NOT untranslated GROUP BY key",
        "untranslated_keys": f"WITH {CATALOG}, {SRC}, {UNUSED} SELECT key, string_agg(locale, ',' ORDER BY locale) locales, count(*) n_locales FROM un WHERE untranslated GROUP BY key",
        "empty_values": f"WITH {CATALOG}, {RBK} SELECT c.key, c.locale, {empty_reason('c.value')} reason, r.fallback FROM cat c LEFT JOIN rbk r ON r.key = c.key WHERE c.locale <> 'en' AND ({empty_reason('c.value')}) IS NOT NULL",
        "suspicious_refs": f"SELECT * FROM (SELECT key, file_path, line, col_no, {suspicion('key')} reason FROM (SELECT coalesce(fallback_literal, key) AS key, file_path, line, col_no FROM refs)) WHERE reason IS NOT NULL",
        "recover_value": f"""WITH {missing('below', "below AS (SELECT * REPLACE ('app.' || key AS key) FROM refs), ")}, {UNUSED.replace('FROM refs', 'FROM below')} SELECT key, from_key, recovered FROM (SELECT m.key, u.key from_key, u.value recovered, row_number() OVER (PARTITION BY m.key ORDER BY length(u.key) DESC, u.key DESC) rn
          FROM mk m JOIN un u ON u.locale = 'en' AND u.value <> '' AND u.key <> m.key AND contains('.' || m.key || '.', '.' || u.key || '.')) WHERE rn = 1""",
        "expand_dynamic": f"WITH {PATTERN_ROWS} SELECT * FROM ex",
        "dynamic_coverage": f"WITH {CATALOG}, {PATTERN_ROWS} SELECT e.pattern, l.locale, count(*) n_missing FROM ex e CROSS JOIN (SELECT DISTINCT locale FROM cat) l WHERE NOT EXISTS (SELECT 1 FROM cat c WHERE c.locale = l.locale AND c.key = e.key) GROUP BY ALL",
        "glob_assumed": f"WITH {CATALOG} SELECT DISTINCT key FROM cat WHERE regexp_matches(key, '^settings\\..*$') OR regexp_matches(key, '^[^.]*\\.confirm[^.]*\\.[^.]*$') OR regexp_matches(key, '^auth\\.ti[^.]le\\.[^.]*$')",
        "key_gaps": f"WITH {CATALOG}, {GAPS} SELECT locale, key FROM gaps",
        "seed_targets": f"WITH {CATALOG}, {GAPS} SELECT locale, key, '[TODO]' AS value FROM gaps WHERE locale <> 'en' AND key IN (SELECT key FROM cat WHERE locale = 'en')",
        "scoped_sync": f"WITH {missing('scoped', SCOPED)} SELECT * FROM mk",
        "locale_diff": f"""WITH {CATALOG}, n AS (SELECT target_locale locale, key, max(translated_value) AS value FROM csv_rows WHERE key IS NOT NULL AND target_locale IS NOT NULL AND NOT {blank('translated_value')} GROUP BY ALL)
          SELECT n.locale, n.key, CASE WHEN c.key IS NULL THEN 'added' ELSE 'updated' END AS change FROM n LEFT JOIN cat c ON c.locale = n.locale AND c.key = n.key WHERE c.value IS DISTINCT FROM n.value""",
        "actionable_items": f"WITH {ITEMS} SELECT * FROM items",
        "items_by_kind": f"WITH {ITEMS} SELECT kind, severity, count(*) n_items, count(DISTINCT key) n_keys FROM items GROUP BY ALL",
        "severity_counts": f"""WITH {ITEMS}, c AS (SELECT count(*) FILTER (WHERE severity = 'error') n_error, count(*) FILTER (WHERE severity = 'warn') n_warn, count(*) FILTER (WHERE severity = 'info') n_info FROM items)
          SELECT *, CASE WHEN n_error > 0 THEN 'error' WHEN n_warn > 0 THEN 'warn' WHEN n_info > 0 THEN 'info' ELSE 'none' END dominant, CASE WHEN n_error > 0 THEN 11 WHEN n_warn > 0 THEN 10 ELSE 0 END exit_code FROM c""",
        "duplicate_values": f"WITH {CATALOG}, {DUPLICATES} SELECT locale, v AS value, n_keys, first_key FROM dup",
        "duplicate_members": f"WITH {CATALOG}, {DUPLICATES} SELECT c.locale, c.key, d.first_key group_key FROM cat c JOIN dup d ON c.locale = d.locale AND lower({trim('c.value')}) = d.folded WHERE length(c.value) >= 3",
        "orphaned_namespaces": f"WITH {CATALOG} SELECT split_part(key, '.', 1) namespace, count(*) n_keys FROM (SELECT DISTINCT {LAST} || '.' || key AS key FROM cat) GROUP BY 1 HAVING count(*) <= 2",
        "inconsistent_prefixes": f"""WITH {CATALOG}, r AS (SELECT lower(split_part(key, '.', 1)) root FROM (SELECT key FROM cat WHERE contains(key, '.') UNION SELECT regexp_replace(key, '^editor[.]', 'authentication.') FROM cat WHERE contains(key, '.'))), p AS (SELECT unnest([{", ".join(q(a) for a, _ in ABBREVIATIONS)}]) a, unnest([{", ".join(q(f) for _, f in ABBREVIATIONS)}]) f)
          SELECT * FROM (SELECT a abbreviation, f AS "full", (SELECT count(*) FROM r WHERE root = a) n_abbreviated, (SELECT count(*) FROM r WHERE root = f) n_full, CASE WHEN (SELECT count(*) FROM r WHERE root = a) > (SELECT count(*) FROM r WHERE root = f) THEN a ELSE f END suggestion FROM p) WHERE n_abbreviated > 0 AND n_full > 0""",
        "namespace_case_variants": f"WITH {KEYS} SELECT lower(ns) namespace, string_agg(ns, ',' ORDER BY ns) variants FROM (SELECT DISTINCT split_part(key, '.', 1) ns FROM ks WHERE contains(key, '.')) GROUP BY 1 HAVING count(*) > 1",
        "locale_consistency": f"WITH {CATALOG}, {GAPS} SELECT locale, count(*) n_missing, min(key) first_missing FROM gaps GROUP BY locale",
        "locale_audit": f"""WITH {CATALOG}, {GAPS}, {DUPLICATES} SELECT c.locale, count(*) n_keys, count(*) FILTER (WHERE {blank('c.value')}) n_blank, (SELECT count(*) FROM dup WHERE dup.locale = c.locale) n_duplicate_groups, (SELECT count(*) FROM gaps WHERE gaps.locale = c.locale) n_missing FROM cat c GROUP BY c.locale""",
        "key_equals_value": f"""WITH {CATALOG.replace("locale_catalog", BY_TEXT)} SELECT locale, key, CASE WHEN same AND (reason IS NULL OR reason = 'single-word-no-namespace') THEN 'key-equals-value' ELSE reason END reason FROM (SELECT *, {suspicion('key')} reason,
          NOT contains(key, '.') AND (key = value OR trim(regexp_replace(lower(key), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g'))) same FROM cat) WHERE reason IS NOT NULL OR same""",
        "audit_key_value": f"""WITH {CATALOG.replace("locale_catalog", BY_TEXT)}, {RBK} SELECT c.key, c.value AS value, coalesce(first_file, 'catalog') file_path, coalesce(first_line, 0) line FROM cat c LEFT JOIN rbk USING (key) WHERE c.locale = 'en' AND NOT contains(c.key, '.')
          AND (c.key = value OR trim(regexp_replace(lower(c.key), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g'))) AND coalesce({suspicion('c.key')}, 'single-word-no-namespace') = 'single-word-no-namespace'""",
        "applied_catalog": f"WITH {applied(value_words)} SELECT locale, key, value FROM done",
        "locale_preview": f"""WITH {applied(value_words)} SELECT locale, count(*) FILTER (WHERE o IS NULL) added, count(*) FILTER (WHERE n IS NULL) removed FROM (SELECT coalesce(c.locale, d.locale) locale, c.key o, d.key n FROM cat c FULL JOIN done d ON c.locale = d.locale AND c.key = d.key)
          WHERE o IS NULL OR n IS NULL GROUP BY locale""",
        "rename_preview": f"""WITH {mapping()} SELECT from_key, to_key, l.locale, f.key IS NULL missing, f.key IS NOT NULL AND t.key IS NOT NULL AS duplicate FROM mp CROSS JOIN (SELECT DISTINCT locale FROM cat) l
          LEFT JOIN cat f ON f.locale = l.locale AND f.key = from_key LEFT JOIN cat t ON t.locale = l.locale AND t.key = to_key WHERE f.key IS NOT NULL OR t.key IS NOT NULL""",
        "renamed_catalog": f"""WITH {mapping()} SELECT locale, CASE WHEN outcome = 'renamed' THEN to_key ELSE key END AS key, value, outcome FROM (SELECT c.locale, c.key, c.value, to_key,
          CASE WHEN to_key IS NULL OR to_key = c.key THEN 'unchanged' WHEN (c.locale, to_key) IN (SELECT (locale, key) FROM cat) THEN 'duplicate' ELSE 'renamed' END outcome FROM cat c LEFT JOIN mp ON from_key = c.key)""",
        "naming_convention": f"""WITH RECURSIVE {CATALOG}, f AS (SELECT locale, naming, row_number() OVER (PARTITION BY locale ORDER BY key) n FROM (SELECT locale, key, {naming} naming FROM cat) WHERE naming <> 'none'),
          w AS (SELECT locale, 0::BIGINT n, 0 k, 0 c, 0 s FROM (SELECT DISTINCT locale FROM f) UNION ALL
            SELECT locale, n, k + (v = 'kebab')::INT, c + (v = 'camel')::INT, s + (v = 'snake')::INT FROM (SELECT w.locale, f.n, k, c, s,
              CASE WHEN naming <> 'neutral' THEN naming WHEN k >= c AND k >= s THEN 'kebab' WHEN c >= s THEN 'camel' ELSE 'snake' END v FROM w JOIN f ON f.locale = w.locale AND f.n = w.n + 1))
          SELECT locale, CASE WHEN k >= c AND k >= s THEN 'kebab-case' WHEN c >= s THEN 'camelCase' ELSE 'snake_case' END AS "convention" FROM (SELECT *, row_number() OVER (PARTITION BY locale ORDER BY n DESC) r FROM w) WHERE r = 1""",
        "incremental_refs": """WITH a AS (SELECT file_path, count(*) n, list_sort(list_distinct(list((key, line, col_no)))) l FROM refs GROUP BY 1) SELECT file_path, CASE WHEN n = len(l) THEN 'reuse' ELSE 'parse' END AS action FROM a""",
        "plan_chunks": f"WITH {CATALOG}, {SRC}, {LENT}, {PLAN} SELECT key, locale, (row_number() OVER (PARTITION BY locale ORDER BY key) - 1) // 25 AS chunk FROM plan",
        "translation_plan": f"WITH {CATALOG}, {SRC}, {LENT}, {PLAN} SELECT * FROM plan",
        "plan_totals": f"WITH {CATALOG}, {SRC}, {LENT}, {PLAN} SELECT locale, count(*) n_tasks, sum(length(source_value))::BIGINT n_chars, count(*) FILTER (WHERE existing IS NULL) n_missing, count(existing) n_existing FROM plan GROUP BY ROLLUP (locale)",
        "reuse_suggestion": f"WITH {CATALOG.replace('locale_catalog', HANDED)}, {LENT} SELECT * FROM lent",
        "executed_plan": f"WITH {CATALOG}, {SRC}, {LENT}, {PLAN} SELECT key, locale, '[' || locale || '] ' || translate(source_value, {q(texts.ACCENTS[0])}, {q(texts.ACCENTS[1])}) translated, NULL::VARCHAR error FROM plan",
        "csv_export": f"""WITH {CATALOG}, {SRC}, {LENT}, {PLAN} SELECT key || ',en,' || CASE WHEN regexp_matches(source_value, '[,"\\r\\n]') THEN '"' || replace(source_value, '"', '""') || '"' ELSE source_value END || ',' || locale || ',' record FROM plan""",
        "write_actions": f"WITH {CATALOG}, {ACTIONS} SELECT * FROM act",
        "write_totals": f"WITH {CATALOG}, {ACTIONS} SELECT locale, count(*) attempted, count(*) FILTER (WHERE action = 'write') written, count(*) FILTER (WHERE action = 'skip-empty') empty_skipped, count(*) FILTER (WHERE action IN ('skip-existing', 'unchanged')) skipped FROM act GROUP BY locale",
        "value_matrix": f"""WITH {CATALOG} SELECT key, count(*)::INT n_locales, string_agg(locale || '=' || CASE WHEN length(value) > 50 THEN substring(value, 1, 47) || '...' ELSE value END, ' | ' ORDER BY locale) preview FROM cat GROUP BY key""",
        "legacy_values": f"WITH {CATALOG}, {SRC} SELECT r.ord cand_id, s.value AS value, 'trimmed' matched FROM refs r JOIN src s ON r.key = s.key",
        "rename_occurrences": f"""WITH {CATALOG}, m AS (SELECT DISTINCT value from_key FROM cat), t AS (SELECT text, {collapse('text')} folded FROM scan_candidates WHERE text IS NOT NULL)
          SELECT from_key, coalesce(e.n, 0) n_exact, coalesce(l.n, 0) - coalesce(e.n, 0) n_normalised FROM m LEFT JOIN (SELECT text, count(*) n FROM t GROUP BY 1) e ON e.text = from_key LEFT JOIN (SELECT folded, count(*) n FROM t GROUP BY 1) l ON l.folded = {collapse('from_key')}""",
        "prefix_collisions": f"""WITH u AS (SELECT locale, key FROM locale_catalog UNION SELECT locale, split_part(key, '.', 1) FROM locale_catalog) SELECT a.locale, a.key, count(*) descendants FROM u a JOIN u b ON a.locale = b.locale AND starts_with(b.key, a.key || '.') GROUP BY ALL""",
        "duplicate_status": "SELECT cand_id, CASE WHEN cand_id = first_id THEN 'pending' ELSE 'duplicate' END status, first_id FROM (SELECT cand_id, min(cand_id) OVER (PARTITION BY text_hash) first_id FROM scan_candidates WHERE text_hash IS NOT NULL)",
        "candidate_dedupe": "SELECT file_path, line, col_no, max(cand_id) cand_id, arg_max(coalesce(text, chr(1)), cand_id) AS text FROM scan_candidates GROUP BY file_path, line, col_no".replace("arg_max(coalesce(text, chr(1)), cand_id) AS text", "nullif(arg_max(coalesce(text, chr(1)), cand_id), chr(1)) AS text"),
        "allocated_hashes": f"""SELECT text, CASE WHEN rn = 1 THEN p ELSE p || rn END AS hash FROM (SELECT text, p, row_number() OVER (PARTITION BY p ORDER BY f) rn FROM (SELECT {collapse('text')} AS text, substring(sha1({collapse('text')}), 1, 5) p, min(cand_id) f FROM scan_candidates WHERE text IS NOT NULL GROUP BY 1, 2))""",
        "edit_conflicts": f"""WITH {EDITS} SELECT * FROM (SELECT a.file, a.id id_a, b.id id_b, CASE WHEN a.s = b.s AND a.e = b.e THEN 'duplicate' WHEN a.s >= b.s AND a.e <= b.e OR b.s >= a.s AND b.e <= a.e THEN 'containment' WHEN a.s < b.e AND b.s < a.e THEN 'overlap' END kind FROM ed a JOIN ed b ON a.file = b.file AND a.id < b.id) WHERE kind IS NOT NULL""",
        "edit_plan": f"""WITH {EDITS} SELECT file, id, s AS "start", e AS "end", r AS replacement FROM ed a WHERE NOT EXISTS (SELECT 1 FROM ed b WHERE a.file = b.file AND a.id <> b.id AND a.s >= b.s AND a.e <= b.e AND NOT (a.s = b.s AND a.e = b.e))""",
        "rollback_offsets": f"""WITH {EDITS} SELECT file, id, coalesce(sum(length(r) - (e - s)) OVER (PARTITION BY file ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT "offset" FROM ed""",
        "html_attributes": f"WITH {oracles_source.ATTRIBUTES} SELECT cand_id, attribute, v AS value, lower(attribute) IN ('alt', 'aria-label', 'aria-description', 'caption', 'helper-text', 'label', 'placeholder', 'title', 'tooltip') translatable FROM a",
        "interpolations": "SELECT cand_id, (i - 1)::INT pos, v[i].name AS name, v[i].expression AS expression, '{{' || v[i].name || '}}' placeholder FROM (SELECT cand_id, interpolation.variables v, unnest(range(1, len(interpolation.variables) + 1)) i FROM scan_candidates WHERE interpolation IS NOT NULL)",
        "html_strings": r"SELECT cand_id, regexp_matches(text, '</?[a-zA-Z][^<>]*>|\{\{.*?\}\}|\bt\(') is_html FROM scan_candidates WHERE text IS NOT NULL",
        "snippets": rf"""WITH {FRAGMENTS} SELECT cand_id, regexp_replace(regexp_replace(text, '[\s{{}}]+', '', 'g'), '[`"]', '''', 'g') snippet, CASE WHEN length(text) > 50 THEN substring(text, 1, 47) || '...' ELSE text END preview FROM fr""",
        "literal_patterns": by_key(r"""'^' || regexp_replace(key, '([.*+?^${}()|\[\]\\])', '\\\1', 'g') || '$' AS pattern"""),
        "matched_files": r"SELECT DISTINCT file_path FROM scan_candidates WHERE (regexp_matches(file_path, '^src/([^/]+/)*[^/]*\.(tsx|vue)$') OR regexp_matches(file_path, '^([^/]*/)*[^/]*\.ts$')) AND NOT starts_with(file_path, 'src/legacy/')",
        "pattern_matches": r"WITH f AS (SELECT DISTINCT file_path p FROM scan_candidates) SELECT 'src/**/*.{tsx,vue}' pattern, 'include' side, count(*) FILTER (WHERE regexp_matches(p, '^src/([^/]+/)*[^/]*\.(tsx|vue)$')) n_files FROM f UNION ALL SELECT '*.ts', 'include', count(*) FILTER (WHERE regexp_matches(p, '^[^/]*\.ts$')) FROM f UNION ALL SELECT 'src/legacy/**', 'exclude', count(*) FILTER (WHERE starts_with(p, 'src/legacy/')) FROM f",
        "translation_usage": r"""SELECT "call", sum(n)::BIGINT n_matches, count(*) n_rows, min(file_path) first_file FROM (SELECT 't' "call", file_path, len(regexp_extract_all(text, '(?:^|[^\w$.])t\(')) n FROM scan_candidates UNION ALL SELECT 'hook', file_path, len(regexp_extract_all(text, '\buse[A-Z]\w*\(')) FROM scan_candidates
          UNION ALL SELECT 'toast', file_path, len(regexp_extract_all(text, '\bshowToast\(')) FROM scan_candidates) WHERE n > 0 GROUP BY 1""",
        "file_extensions": r"SELECT regexp_extract(file_path, '\.([A-Za-z0-9]+)$', 1) extension, count(*) n_files, count(*) / (SELECT count(DISTINCT file_path) FROM refs) share FROM (SELECT DISTINCT file_path FROM refs) GROUP BY 1",
        "source_language": f"WITH {CATALOG} SELECT locale FROM (SELECT locale, count(*) n FROM cat GROUP BY 1) ORDER BY CASE lower(locale) WHEN 'en' THEN 0 WHEN 'en-us' THEN 1 WHEN 'en-gb' THEN 1 ELSE 2 END, CASE WHEN lower(locale) LIKE 'en%' THEN 0 ELSE -n END, locale LIMIT 1",
        "rename_proposals": f"""WITH {CATALOG}, r AS (SELECT key FROM refs UNION SELECT 'Save The Report ' || col_no FROM refs), p AS (SELECT key, {suspicion('key')} reason FROM r WHERE key IS NOT NULL),
          m AS (SELECT key, reason, CASE reason WHEN 'single-word-no-namespace' THEN 'common.' || lower(key) WHEN 'trailing-punctuation' THEN regexp_replace(key, '[:?!]+$', '') ELSE {normalized('key', '-')} END proposed FROM p WHERE reason IS NOT NULL)
          SELECT key, proposed, reason, CASE WHEN proposed IN (SELECT key FROM cat) THEN 'existing' WHEN key <> min(key) OVER (PARTITION BY proposed) THEN 'repeated' END AS conflict FROM m""",
        "cache_hit_rate": "SELECT event_type kind, count(*) FILTER (WHERE value > 50) n_hits, count(*) FILTER (WHERE value <= 50) n_misses, count(*) FILTER (WHERE value > 50) / count(value) hit_rate FROM events GROUP BY 1",
        "framework_confidence": "SELECT framework, confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence >= 0.3 THEN 'low' ELSE 'uncertain' END AS level FROM (SELECT event_type || user_id framework, least(round(sum(round(value / 1000, 3)), 6), 1.0) confidence FROM events GROUP BY 1)",
        "debounce_sessions": """SELECT "trigger", min(ts) started, max(ts) + INTERVAL 10 MINUTE ended, count(*) n_events FROM (SELECT *, sum(new) OVER (PARTITION BY "trigger" ORDER BY ts, event_id) s FROM (SELECT event_type "trigger", ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END new FROM events)) GROUP BY "trigger", s""",
        "circuit_breaker": """SELECT stream, count(*) FILTER (WHERE n >= 3) n_openings FROM (SELECT stream, island, count(*) n FROM (SELECT user_id stream, value < 40 failed, sum(CASE WHEN value < 40 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) island FROM events) WHERE failed GROUP BY 1, 2) GROUP BY 1""",
    }

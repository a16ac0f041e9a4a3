"""SQL equivalents of the queries on reports, configuration values, calls, caches and catalog files."""

from __future__ import annotations

from lexiloom.functions import config
from lexiloom.plans.oracles import CATALOG, DUPLICATES, GAPS, ITEMS, KEYS, blank, missing, q, suspicion, trim
from lexiloom.plans.oracles_source import LEXED, matches

COMMAND = r"""(?s)"(?:\\.|[^"\\])*(?:"|\\?$)|'(?:\\.|[^'\\])*(?:'|\\?$)|[^\s"']+"""


def unwrapped(x: str) -> str:
    t = trim(x)
    inner = f"CASE WHEN regexp_matches({t}, {q(r'(?s)^(?:`.*`|' + chr(34) + '.*' + chr(34) + r'|' + chr(39) + '.*' + chr(39) + ')$')}) THEN {trim(f'substring({t}, 2, length({t}) - 2)')} ELSE {t} END"
    return f"CASE WHEN regexp_matches({inner}, '(?s)^\\(.*\\)$') THEN {trim(f'substring({inner}, 2, length({inner}) - 2)')} ELSE {inner} END"


def static_path(x: str) -> str:
    out = f"regexp_replace(regexp_replace({unwrapped(x)}, {q(chr(92) + '$' + chr(92) + '{[^}]+' + chr(92) + '}')}, '*', 'g'), '[^A-Za-z0-9_*.-]', '', 'g')"
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({out}, '\\.{{2,}}', '.', 'g'), '\\*{{2,}}', '*', 'g'), '^\\.', ''), '\\.$', '')"


def resolved() -> str:
    """Five moves, each a step that looks keys up in the catalog."""
    step = lambda i, frm: f"""s{i} AS (SELECT key, CASE WHEN u AND contains(made, '.') THEN regexp_replace(made, '\\.([^.]*)$', '_\\1') WHEN u THEN made || '_{i}' WHEN c THEN made || '_text' ELSE made END made, n + (u OR c)::INT n FROM {frm}),
      c{i} AS (SELECT *, EXISTS (SELECT 1 FROM k WHERE starts_with(s{i}.made, k.key || '.')) u, EXISTS (SELECT 1 FROM k WHERE starts_with(k.key, s{i}.made || '.')) c FROM s{i})"""  # noqa: E731
    steps = ", ".join(step(i, f"c{i - 1}") for i in range(1, 6))
    return f"""WITH {CATALOG}, k AS (SELECT DISTINCT key FROM cat), s0 AS (SELECT DISTINCT suggested_key AS key, suggested_key made, 0 n FROM scan_candidates WHERE suggested_key IS NOT NULL),
      c0 AS (SELECT *, EXISTS (SELECT 1 FROM k WHERE starts_with(s0.made, k.key || '.')) u, EXISTS (SELECT 1 FROM k WHERE starts_with(k.key, s0.made || '.')) c FROM s0), {steps}
      SELECT key, made, n AS attempts, CASE WHEN u OR c THEN 'skipped' WHEN n > 0 THEN 'moved' ELSE 'free' END status FROM c5"""


def places() -> str:
    """Where calls with a literal key stand, by summing up the lengths of all tokens before them."""
    return rf"""WITH t AS (SELECT cand_id, text, unnest(range(1, len(ts) + 1)) i, unnest(ts) t FROM (SELECT cand_id, text, regexp_extract_all(text, {q(LEXED)}) ts FROM scan_candidates WHERE contains(text, 't(') AND NOT contains(text, '`'))),
      p AS (SELECT cand_id, text, t, coalesce(sum(length(t)) OVER (PARTITION BY cand_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT o FROM t)
      SELECT cand_id, regexp_extract(t, '^t\(\s*[''"](.*).$', 1) AS key, (1 + length(left(text, o)) - length(replace(left(text, o), chr(10), '')))::INT line, (1 + length(regexp_extract(left(text, o), '([^\n]*)$', 1)))::INT col_no
      FROM p WHERE regexp_matches(t, '^t\(\s*[''"]')"""


def oracle_sql() -> dict[str, str]:
    bare = lambda x: f"CASE WHEN regexp_matches({x}, '^[''\"]') THEN regexp_replace(regexp_replace(regexp_replace({x}, '^[''\"]', ''), CASE WHEN starts_with({x}, '\"') THEN '\"$' ELSE '''$' END, ''), '(?s)\\\\(.)', '\\1', 'g') ELSE {x} END"
    like = lambda x, p: matches(x, p)
    bound = r"""list_concat(list_transform(regexp_extract_all(text, '\s(?:v-bind)?:([A-Za-z][A-Za-z0-9_-]*)\s*=\s*"([^"<>]*)"'), lambda x: {'a': regexp_extract(x, ':([A-Za-z][A-Za-z0-9_-]*)\s*=', 1), 'e': regexp_extract(x, '(?s)=\s*"(.*)"$', 1)}),
      list_transform(regexp_extract_all(text, '\s([A-Za-z][A-Za-z0-9_-]*)\s*=\s*\{([^{}<>]*)\}'), lambda x: {'a': regexp_extract(x, '^\s([A-Za-z][A-Za-z0-9_-]*)', 1), 'e': regexp_extract(x, '(?s)=\s*\{(.*)\}$', 1)}))"""
    literals = rf"""list_filter(CASE WHEN contains(e, '`') THEN [{trim(r"regexp_replace(replace(e, '`', ''), '\$\{[^}]*\}', '', 'g')")}] ELSE list_transform(regexp_extract_all(e, '''[^''"]*''|"[^''"]*"'), lambda x: {trim('substring(x, 2, length(x) - 2)')}) END, lambda x: x <> '')"""
    quoted = "(length(v) > 1 AND (starts_with(v, '\"') AND ends_with(v, '\"') OR starts_with(v, '''') AND ends_with(v, '''')))"
    kind = rf"CASE WHEN v IN ('true', 'false') THEN 'boolean' WHEN v = 'null' THEN 'null' WHEN regexp_matches(v, '^-?\d+(\.\d+)?$') THEN 'number' WHEN regexp_matches(v, '(?s)^(\[.*\]|\{{.*\}})$') AND json_valid(v) THEN 'json' WHEN {quoted} THEN 'quoted' ELSE 'string' END"
    many = lambda n, w: f"CASE WHEN {n} > 0 THEN {n} || ' {w}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END END"
    return {
        "call_positions": places(),
        "exit_code": f"WITH {ITEMS} SELECT CASE WHEN bool_or(kind = 'suspicious-key') THEN 4 WHEN bool_or(kind = 'placeholder-mismatch') THEN 2 WHEN bool_or(kind = 'empty-value') THEN 3 WHEN bool_or(kind IN ('missing-key', 'unused-key')) THEN 1 ELSE 0 END exit_code FROM items",
        "drift_stats": f"WITH {ITEMS} SELECT count(*) FILTER (WHERE kind = 'missing-key') n_missing, count(*) FILTER (WHERE kind = 'unused-key') n_unused FROM items HAVING n_missing > 0 OR n_unused > 0",
        "health": f"""WITH {ITEMS}, c AS (SELECT coalesce(bool_or(kind IN ('missing-key', 'unused-key')), false) has_drift, coalesce(bool_or(kind = 'placeholder-mismatch'), false) has_conflicts, count(*) n_items, count(DISTINCT key) n_keys,
          count(*) FILTER (WHERE severity = 'error') e, count(*) FILTER (WHERE severity = 'warn') w, count(*) FILTER (WHERE severity = 'info') i FROM items)
          SELECT has_drift, has_conflicts, n_items, n_keys, concat_ws(', ', CASE WHEN e > 0 THEN e || ' critical' END, {many('w', 'warning')}, {many('i', 'info')}) summary FROM c""",
        "unique_items": f"""WITH {ITEMS}, a AS (SELECT * FROM items UNION ALL SELECT kind, 'info', key, locale FROM items WHERE severity = 'error') SELECT kind, key, locale, CASE min(CASE severity WHEN 'error' THEN 1 WHEN 'warn' THEN 2 ELSE 3 END) WHEN 1 THEN 'error' WHEN 2 THEN 'warn' ELSE 'info' END severity, count(*) n_copies FROM a GROUP BY kind, key, locale""",
        "file_issues": f"""WITH {missing()}, g AS (SELECT file_path, count(*)::BIGINT n_references, count(*) FILTER (WHERE key IN (SELECT key FROM mk))::BIGINT n_missing, count(*) FILTER (WHERE ({suspicion('key')}) IS NOT NULL)::BIGINT n_suspicious FROM refs WHERE key IS NOT NULL GROUP BY file_path)
          SELECT * FROM g WHERE n_missing > 0 OR n_suspicious > 0""".replace("count(*) FILTER (WHERE key IN (SELECT key FROM mk))::BIGINT", "(count(*) FILTER (WHERE key IN (SELECT key FROM mk)))::BIGINT").replace(f"count(*) FILTER (WHERE ({suspicion('key')}) IS NOT NULL)::BIGINT", f"(count(*) FILTER (WHERE ({suspicion('key')}) IS NOT NULL))::BIGINT"),
        "coverage": f"""WITH {CATALOG}, w AS (SELECT key FROM cat WHERE locale = 'en' AND NOT {blank('value')}), h AS (SELECT locale, count(*) FILTER (WHERE NOT {blank('value')} AND key IN (SELECT key FROM w)) n FROM cat WHERE locale <> 'en' GROUP BY 1)
          SELECT locale, (SELECT count(*) FROM w) n_source, n AS n_covered, CASE WHEN (SELECT count(*) FROM w) > 0 THEN n / (SELECT count(*) FROM w) ELSE 1.0 END share FROM h""",
        "quality_report": f"""WITH {CATALOG}, {GAPS}, {DUPLICATES} SELECT locale, 'duplicate-value' "check", v AS subject, n_keys AS n FROM dup UNION ALL SELECT locale, 'missing-keys', min(key), count(*) FROM gaps GROUP BY locale
          UNION ALL SELECT NULL, 'orphaned-namespace', split_part(key, '.', 1), count(*) FROM (SELECT DISTINCT key FROM cat WHERE contains(key, '.')) GROUP BY 3 HAVING count(*) <= 2
          UNION ALL SELECT NULL, 'case-variants', lower(ns), count(*) FROM (SELECT DISTINCT split_part(key, '.', 1) ns FROM cat WHERE contains(key, '.')) GROUP BY 3 HAVING count(*) > 1""",
        "equal_catalogs": f"""WITH {CATALOG}, n AS (SELECT DISTINCT target_locale locale FROM csv_rows r WHERE key IS NOT NULL AND target_locale IS NOT NULL AND NOT {blank('translated_value')}
            AND NOT EXISTS (SELECT 1 FROM cat c WHERE c.locale = r.target_locale AND c.key = r.key AND c.value = (SELECT max(translated_value) FROM csv_rows x WHERE x.key = r.key AND x.target_locale = r.target_locale AND NOT {blank('x.translated_value')})))
          SELECT locale, locale NOT IN (SELECT locale FROM n) equal FROM (SELECT locale FROM cat UNION SELECT target_locale FROM csv_rows WHERE key IS NOT NULL AND target_locale IS NOT NULL AND NOT {blank('translated_value')})""",
        "shape_guess": f"WITH {CATALOG} SELECT count(*) n_locales, max(n) largest, CASE WHEN max(n) > 50 THEN 'auto' ELSE 'flat' END shape FROM (SELECT count(*) n FROM cat GROUP BY locale)",
        "pattern_advice": r"""WITH f AS (SELECT DISTINCT file_path p FROM scan_candidates), n AS (SELECT count(*) FILTER (WHERE regexp_matches(p, '^src/([^/]+/)*[^/]*\.(tsx|vue)$')) a, count(*) FILTER (WHERE regexp_matches(p, '^[^/]*\.ts$')) b, count(*) FILTER (WHERE starts_with(p, 'src/legacy/')) x FROM f)
          SELECT 'src/**/*.{tsx,vue}' pattern, 'check-source-folder' advice FROM n WHERE a = 0 UNION ALL SELECT '*.ts', 'no-such-files' FROM n WHERE b = 0 UNION ALL SELECT '*', 'excludes-too-broad' FROM n WHERE a + b > 0 AND x > 0.9 * (a + b)
          UNION ALL SELECT '/lib/*.js', 'no-such-files' UNION ALL SELECT '/lib/*.js', 'leading-slash'""",
        "requested_locales": f"WITH {CATALOG} SELECT DISTINCT locale FROM cat WHERE locale IN ('de', 'ja')",
        "report_json": f"""WITH {ITEMS} SELECT kind, '{{"kind":"' || kind || '","severity":"' || severity || '","key":"' || key || '","locale":' || coalesce('"' || locale || '"', 'null') || '}}' document FROM items""",
        "report_markdown": f"WITH {ITEMS} SELECT '| ' || kind || ' | ' || severity || ' | ' || count(*) || ' |' line FROM items GROUP BY kind, severity",
        "newest_crawls": """SELECT project, last, CASE WHEN rn <= 5 THEN rn END::INT "rank", rn <= 5 kept FROM (SELECT project, last, row_number() OVER (ORDER BY last DESC) rn FROM (SELECT project, max(doc_id) last FROM documents WHERE project IS NOT NULL GROUP BY project))""",
        "key_collisions": resolved(),
        "config_safety": f"""SELECT v AS value, regexp_matches(v, {q(config.CONTROL)}) OR regexp_matches(v, {q(config.SHELL_META)}) unsafe, {like('v', config.LANGUAGE_TAG)} language_tag, {like('v', config.IDENTIFIER)} identifier, {like('v', config.NAMESPACE)} namespace,
          CASE WHEN {blank('v')} THEN 'empty' WHEN length(v) > 320 THEN 'too-long' WHEN regexp_matches(v, {q(config.CONTROL)}) OR regexp_matches(v, {q(config.SHELL_META)}) THEN 'unsafe' END path_problem
          FROM (SELECT file_path v FROM refs UNION SELECT key FROM refs UNION SELECT target_locale FROM import_rows UNION SELECT translated_value FROM import_rows) WHERE v IS NOT NULL""",
        "config_values": f"""SELECT imp_id, {kind} kind, CASE WHEN ({kind}) = 'quoted' THEN substring(v, 2, length(v) - 2) ELSE v END plain, array_to_string(list_filter(list_transform(string_split(v, ','), lambda x: {trim('x')}), lambda x: x <> ''), '|') listed,
          array_to_string(list_filter(string_split(v, '.'), lambda x: x <> ''), '/') path FROM (SELECT imp_id, translated_value v FROM import_rows WHERE translated_value IS NOT NULL)""",
        "positive_integers": r"SELECT key, n, least(200, greatest(1, coalesce(n, 20)))::INT clamped FROM (SELECT key, CASE WHEN regexp_matches(d, '^[0-9]{1,18}$') AND d::BIGINT > 0 THEN d::BIGINT END n FROM (SELECT DISTINCT key, regexp_extract(key, '([^.]*)$', 1) d FROM (SELECT key FROM refs UNION ALL SELECT 'n.' || line FROM refs)))",
        "command_words": f"SELECT cand_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, {q(COMMAND)}), lambda x: {bare('x')}), lambda x: x <> ''), chr(31)) words FROM scan_candidates WHERE text IS NOT NULL",
        "small_signs": f"SELECT cand_id, {like('text', config.HTML_ENTITY)} entity, {like('text', config.HEX_COLOUR)} hex_colour, length(text) > 1 AND text = repeat(left(text, 1), length(text)) AND regexp_matches(left(text, 1), '[^\\pL\\d\\s]') repeated FROM scan_candidates WHERE text IS NOT NULL",
        "text_places": "SELECT cand_id, (length(left(text, o)) - length(replace(left(text, o), chr(10), '')))::INT line, length(regexp_extract(left(text, o), '([^\\n]*)$', 1))::INT col FROM (SELECT cand_id, text, strpos(text, '''') - 1 o FROM scan_candidates) WHERE o >= 0",
        "event_ages": """SELECT event_id, CASE WHEN s < 10 THEN 'just now' WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE strftime(ts, '%Y-%m-%d') END age
          FROM (SELECT event_id, ts, epoch(date_trunc('second', (SELECT max(ts) FROM events)))::BIGINT - epoch(date_trunc('second', ts))::BIGINT s FROM events)""",
        "static_paths": f"SELECT cand_id, {static_path('text')} path FROM scan_candidates WHERE text IS NOT NULL",
        "bound_attributes": f"SELECT cand_id, attribute, expression, unnest(list_distinct({literals})) literal FROM (SELECT cand_id, b.a attribute, b.e expression, b.e e FROM (SELECT cand_id, unnest(list_distinct({bound})) b FROM scan_candidates WHERE contains(text, '=')))",
        "variable_names": r"""SELECT cand_id, pos, CASE WHEN regexp_matches(e, '^[A-Za-z_$][A-Za-z0-9_$]*$') THEN e WHEN regexp_matches(e, '\.([A-Za-z_$][A-Za-z0-9_$]*)$') THEN regexp_extract(e, '\.([A-Za-z_$][A-Za-z0-9_$]*)$', 1) WHEN regexp_matches(e, '^[A-Za-z_$][A-Za-z0-9_$]*\[')
          THEN CASE WHEN ends_with(l, 's') THEN left(l, length(l) - 1) ELSE l || 'Item' END ELSE 'var1' END AS name FROM (SELECT *, regexp_extract(e, '^([A-Za-z_$][A-Za-z0-9_$]*)\[', 1) l FROM (SELECT cand_id, pos, trim(e) e FROM (SELECT cand_id, (unnest(range(1, len(interpolation.variables) + 1)) - 1)::INT pos, unnest(interpolation.variables).expression e FROM scan_candidates WHERE interpolation IS NOT NULL)))""",
        "without_openers": r"SELECT cand_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\(\s*\{', '{', 'g'), '\[\s*\{', '{', 'g'), '\s+', ' ', 'g')) AS bare FROM scan_candidates WHERE text IS NOT NULL",
        "cache_reasons": """SELECT event_id, concat_ws(',', CASE WHEN version IS DISTINCT FROM '1' THEN 'version' END, CASE WHEN identifier IS DISTINCT FROM 't' THEN 'translationIdentifier' END, CASE WHEN config_hash <> 'c0' THEN 'config' END, CASE WHEN tool_version <> 'v2' THEN 'toolVersion' END) reasons
          FROM (SELECT event_id, CASE WHEN user_id % 5 <> 0 THEN (user_id % 3)::VARCHAR END "version", CASE WHEN user_id % 7 <> 0 THEN 't' END identifier, CASE WHEN user_id % 4 <> 0 THEN 'c' || (user_id % 2) END config_hash, CASE WHEN event_type <> 'view' THEN 'v2' END tool_version FROM events)""",
        "file_fingerprints": "SELECT file_path, count(*) || ':' || sum(('0x' || substring(md5(key || '|' || line || '|' || col_no), 1, 10))::BIGINT)::BIGINT fingerprint FROM refs GROUP BY 1",
        "catalog_files": f"WITH {CATALOG} SELECT locale, key, value FROM cat",
        "normal_locales": f"SELECT DISTINCT target_locale AS label, lower(replace({trim('target_locale')}, '_', '-')) AS locale FROM import_rows WHERE target_locale IS NOT NULL",
        "key_components": f"WITH {KEYS} SELECT key, regexp_matches('.' || key || '.', '^[.]?.*[.]' || x || '[.]') AND regexp_matches(key, '(^|[.])' || x || '([.]|$)') AND strpos(key, x) > 0 AND key <> x AND (strpos(key, x) = 1 OR key[strpos(key, x) - 1] = '.') AND (strpos(key, x) + length(x) - 1 = length(key) OR key[strpos(key, x) + length(x)] = '.') AS component FROM (SELECT key, 'title' x FROM ks)",
        "template_syntax": r"""WITH RECURSIVE d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '\{\{')) - len(regexp_extract_all(x, '\}\}'))) ds, len(regexp_extract_all(text, '\{\{'))::INT n_open, len(regexp_extract_all(text, '\}\}'))::INT n_close FROM (SELECT row_id doc_id, translated_value AS text FROM csv_rows) WHERE contains(text, '{{') OR contains(text, '}}')),
          w AS (SELECT doc_id, 0 i, 0::BIGINT b, NULL::INT f FROM d UNION ALL SELECT w.doc_id, i + 1, greatest(b + ds[i + 1], 0), CASE WHEN f IS NULL AND b + ds[i + 1] < 0 THEN i + 1 ELSE f END FROM w JOIN d USING (doc_id) WHERE i < len(ds))
          SELECT d.doc_id AS row_id, n_open, n_close, f AS first_unexpected, b::INT AS n_unclosed FROM d JOIN w ON w.doc_id = d.doc_id AND i = len(ds) WHERE n_open <> n_close OR f IS NOT NULL OR b > 0""",
    }




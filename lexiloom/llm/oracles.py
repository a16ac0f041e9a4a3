"""SQL equivalents, in DuckDB's dialect, of those queries of this subpackage that SQL can state over whole tables."""

from __future__ import annotations

SPACES = r"[\t-\r\x{85}\p{Z}]"
DROPPED = r"[\pP\pZ\p{Cc}\s|`´^¨=<>~]+"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '{DROPPED}', '', 'g')"


def _folded(x: str) -> str:
    return f"replace(lower(upper({x})), 'ß', 'ss')"


def _key(x: str) -> str:
    return f"CASE WHEN {_bare(_folded(x))} = '' THEN regexp_replace({x}, '{SPACES}+', '', 'g') ELSE {_bare(_folded(x))} END"


def _parts(x: str, separators: str) -> str:
    full = f"list_filter(regexp_split_to_array({_folded(x)}, '{separators}'), lambda p: regexp_matches(p, '[\\pL\\pN_]'))"
    pair = f"{_bare("split_part(replace(p, '：', ':'), ':', 1)")} || chr(31) || {_bare("regexp_replace(p, '^[^:：]*[:：]', '')")}"
    labelled = f"len(list_filter({full}, lambda p: NOT regexp_matches(p, '^[^:：]*[\\pL\\pN_][^:：]*[:：]'))) = 0"
    return f"CASE WHEN len({full}) > 1 AND {labelled} THEN array_to_string(list_sort(list_transform({full}, lambda p: {pair})), chr(30)) END"


def _text(x: str) -> str:
    return f"CASE WHEN len(regexp_extract_all({x}, '[:：]')) > 1 THEN coalesce({_parts(x, '[;|/•,]')}, {_parts(x, '[\\r\\n]+')}, {_key(x)}) ELSE {_key(x)} END"


MEMBERS = f"""m AS (SELECT tab_name, id, min(id) OVER (PARTITION BY tab_name, canon) head FROM (
  SELECT 'csv_rows' tab_name, row_id id, target_locale || chr(29) || {_key('key')} || chr(29) || {_text('source_value')} canon FROM csv_rows
  UNION ALL SELECT 'scan_candidates', cand_id, {_key('suggested_key')} || chr(29) || {_text('text')} FROM scan_candidates) WHERE canon IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": f"WITH {MEMBERS} SELECT tab_name, head id_a, id id_b FROM m WHERE id <> head",
        "p6_representatives": f"WITH {MEMBERS} SELECT tab_name, head id, count(*) n_copies FROM m GROUP BY ALL",
    }

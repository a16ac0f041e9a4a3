"""The registry of the core's queries: name -> (spark, folder) -> DataFrame. SQL equivalents are in `oracles`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import config, expressions, keys, placeholders, texts
from lexiloom.operators import calls, edits, extract, markup, project, quality, rejects, rename, report, rollup, sync, translate, translators
from lexiloom.plans import oracles, oracles_report
from lexiloom.session import spread
from lexiloom.sources.relations import catalog, references_by_key
from lexiloom.sources import catalog_files
from lexiloom.sources.tables import table
from lexiloom.storage import run_folder
from lexiloom.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]

# Configuration of the registered queries.
DYNAMIC_PATTERNS = (("settings.*.label", ("upload", "share", "retry")), ("auth.*", ("title", "error.note")), ("common.save", ()), ("common.cancel", ("now", "later")))
INCLUDE, EXCLUDE = ("src/**/*.{tsx,vue}", "*.ts"), ("src/legacy/**",)
GLOBS = ("settings.**", "*.confirm*.*", "auth.ti?le.*")


def _lines(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(s, d, "csv_lines", "line_id", "file_name", "line_no", "raw"), table(s, d, "locales", "locale")


def _catalog(s: SparkSession, d: str) -> DataFrame:
    return catalog(table(s, d, "locale_catalog", "locale", "key", "value", "ord"))


def _refs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "refs", "key", "file_path", "line", "col_no", "fallback_literal", "ord")


def _named_by_text(s: SparkSession, d: str) -> DataFrame:
    """The catalog and source keys made of short texts, as they come about where texts are used for keys."""
    short = table(s, d, "scan_candidates", "cand_id", "text").where((F.length("text") < 30) & ~F.col("text").contains("."))
    made = short.select(F.lit("en").alias("locale"), F.replace(F.lower("text"), F.lit(" "), F.lit("-")).alias("key"), F.col("text").alias("value"), F.col("cand_id").alias("ord"))
    return catalog(table(s, d, "locale_catalog", "locale", "key", "value", "ord").unionByName(made))


def _handed_over(s: SparkSession, d: str) -> DataFrame:
    """The hand-off rows as a catalog of many regional locales."""
    rows = table(s, d, "csv_rows", "row_id", "key", "target_locale", "translated_value").where("target_locale is not null and translated_value is not null")
    return catalog(rows.select(F.col("target_locale").alias("locale"), "key", F.col("translated_value").alias("value"), F.col("row_id").alias("ord")))


def _keys(s: SparkSession, d: str) -> DataFrame:
    """Every distinct key of the catalogs, the references and the hand-off rows."""
    parts = [table(s, d, t, c).select(F.col(c).alias("key")) for t, c in (("locale_catalog", "key"), ("refs", "key"), ("csv_rows", "key"), ("scan_candidates", "suggested_key"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).where("key is not null").distinct()


def _texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "scan_candidates", "cand_id", "text").where("text is not null")


def _fragments(s: SparkSession, d: str) -> DataFrame:
    """Every candidate's text, whatever its kind."""
    return table(s, d, "scan_candidates", "cand_id", "text")


def _candidates(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "scan_candidates")


def _edits(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    number = (F.col("l_linenumber") * 10**12 + F.col("l_partkey") * 10**6 + F.col("l_suppkey")).cast("long")
    start = (F.col("l_linenumber") * 10).cast("long")
    one = rows.groupBy(F.col("l_orderkey").alias("file"), number.alias("id"), start.alias("start")).agg(F.max("l_quantity").alias("n"), F.max("l_returnflag").alias("replacement"))
    return one.select("file", "id", "start", (F.col("start") + F.col("n")).cast("long").alias("end"), "replacement")


def _mappings(s: SparkSession, d: str) -> DataFrame:
    made = rename.proposals(_refs(s, d), _catalog(s, d)).select(F.col("key").alias("from_key"), F.col("proposed").alias("to_key"))
    named = _catalog(s, d).select("key").distinct().where(F.col("key").contains("_")).select(F.col("key").alias("from_key"), F.replace("key", F.lit("_"), F.lit("-")).alias("to_key"))
    return made.unionByName(named).distinct()


def _patterns(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(p, list(v)) for p, v in DYNAMIC_PATTERNS], "pattern string, values array<string>")


def _joined(c: Column) -> Column:
    return F.array_join(c, ",")


def _by_key(f: Callable[[Column], dict[str, Column]]) -> Query:
    return lambda s, d: _keys(s, d).select("key", *[c.alias(n) for n, c in f(F.col("key")).items()])


def _by_text(f: Callable[[Column], dict[str, Column]], keep: str | None = None) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        out = _texts(s, d).select("cand_id", *[c.alias(n) for n, c in f(F.col("text")).items()])
        return out.where(keep) if keep else out

    return run


def _changed_catalog(s: SparkSession, d: str) -> DataFrame:
    """The catalog as sync would leave it."""
    return sync.applied(_refs(s, d), _catalog(s, d))


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events", "event_id", "ts", "user_id", "event_type", "value")


def _sources(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "scan_candidates", "cand_id", "file_path", "text")


def _items(s: SparkSession, d: str) -> DataFrame:
    return rollup.actionable_items(_refs(s, d), _catalog(s, d))


def _doubled(items: DataFrame) -> DataFrame:
    """Findings with a second, lesser telling of those that are errors."""
    return items.unionByName(items.where("severity = 'error'").withColumn("severity", F.lit("info")))


def _calls(s: SparkSession, d: str) -> DataFrame:
    return calls.scanned(_fragments(s, d))


def _file_patterns(s: SparkSession, d: str) -> DataFrame:
    return project.pattern_matches(table(s, d, "scan_candidates", "file_path"), [*INCLUDE, "/lib/*.js"], list(EXCLUDE))


def _settings(s: SparkSession, d: str) -> DataFrame:
    """Values of every sort: paths, keys, labels and texts."""
    parts = [table(s, d, t, c).select(F.col(c).alias("value")) for t, c in (("refs", "file_path"), ("refs", "key"), ("import_rows", "target_locale"), ("import_rows", "translated_value"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).where("value is not null").distinct()


def _headers(s: SparkSession, d: str) -> DataFrame:
    """Headers of caches as they may be found: fields absent, old or current."""
    u = F.col("user_id")
    found = lambda keep, c: F.when(keep, c)
    return _events(s, d).select("event_id", found(u % 5 != 0, (u % 3).cast("string")).alias("version"), found(u % 7 != 0, F.lit("t")).alias("identifier"), found(u % 4 != 0, F.concat(F.lit("c"), (u % 2).cast("string"))).alias("config_hash"), found(F.col("event_type") != "view", F.lit("v2")).alias("tool_version"))


def _through_files(s: SparkSession, d: str) -> DataFrame:
    """The catalog after being written as one document per locale and read again."""
    folder = f"{run_folder(s)}/catalog-files-{uuid.uuid4().hex}"
    catalog_files.write_catalogs(_catalog(s, d), folder, nested=False)
    return catalog_files.read_catalogs(s, folder).select("locale", "key", "value")


def _pattern_columns(t: Column) -> dict[str, Column]:
    p = texts.detected_pattern(t)
    return {"pattern": p["name"], "category": p["category"], "confidence": p["confidence"]}


def queries() -> dict[str, Query]:
    return {
        # Loading
        "p3_found": lambda s, d: rejects.rejected(*_lines(s, d)),
        "p3_loaded": lambda s, d: rejects.loaded(*_lines(s, d)),
        # Keys
        "suspicious_keys": lambda s, d: _by_key(lambda k: {"reason": keys.suspicion(k)})(s, d).where("reason is not null"),
        "key_format": _by_key(lambda k: {"valid": keys.is_key_format(k)}),
        "convention_check": _by_key(lambda k: {n.split("-")[0].split("_")[0].removesuffix("Case"): keys.follows(keys.last_segment(k), n) for n in keys.CONVENTIONS}),
        "normalize_to_key": _by_key(lambda k: {"kebab": keys.normalized_key(k), "snake": keys.normalized_key(k, "snake_case")}),
        "suggest_fix": lambda s, d: _by_key(lambda k: {"fix": keys.suggested_fix(k, keys.suspicion(k))})(s, d).where("fix is not null"),
        "value_from_key": _by_key(lambda k: {"value": keys.value_from_key(k)}),
        "generate_key_snake": _by_text(lambda t: {"made": keys.generated_key(t, "snake")}),
        "generate_key_kebab": _by_text(lambda t: {"made": keys.generated_key(t, "kebab")}),
        "generate_key_camel": _by_text(lambda t: {"made": keys.generated_key(t, "camel")}),
        "text_hash": lambda s, d: _texts(s, d).select("cand_id", keys.text_hash(F.col("text")).alias("hash")),
        "key_digest": lambda s, d: _candidates(s, d).where("text is not null").select("cand_id", keys.digest(F.col("text"), F.col("kind"), F.col("context")).alias("digest")),
        "key_full": lambda s, d: spread(table(s, d, "scan_candidates", "cand_id", "file_path", "context", "text", "kind").where("text is not null")).select("cand_id", keys.full_key("app", F.col("file_path"), F.col("context"), F.col("text"), F.col("kind")).alias("made")),
        "naming_votes": lambda s, d: quality.naming_votes(_catalog(s, d)),
        "naming_convention": lambda s, d: quality.naming_convention(_catalog(s, d)),
        # Texts
        "text_filter": lambda s, d: spread(table(s, d, "scan_candidates", "cand_id", "text")).select("cand_id", texts.skip_reason(F.col("text")).alias("reason")),
        "css_class_list": _by_text(lambda t: {"is_list": texts.is_class_list(t)}),
        "sql_prefix": lambda s, d: _texts(s, d).select("cand_id", texts.before_query(F.col("text")).alias("prefix"), "text").where("prefix <> text").select("cand_id", "prefix"),
        "pattern_detect": _by_text(_pattern_columns, "pattern is not null"),
        "pattern_detect_all": _by_text(lambda t: {"patterns": _joined(texts.detected_patterns(t))}, "patterns <> ''"),
        "confidence_bucket": lambda s, d: rollup.buckets(_candidates(s, d)),
        "skip_reason_topk": lambda s, d: rollup.skip_reason_topk(spread(table(s, d, "scan_candidates", "text"))),
        "html_decode": _by_text(lambda t: {"decoded": texts.decoded(t)}),
        "pseudo_localize": lambda s, d: _catalog(s, d).select("locale", "key", texts.pseudo_localized(F.col("value"), F.col("locale")).alias("pseudo")),
        # Placeholders
        "extract_placeholders": lambda s, d: _catalog(s, d).select("locale", "key", _joined(placeholders.extract(F.col("value"))).alias("tokens")),
        "placeholder_issues": lambda s, d: sync.placeholder_issues(_catalog(s, d)),
        "csv_placeholder_checks": lambda s, d: translate.import_checks(table(s, d, "csv_rows", "row_id", "source_value", "translated_value")),
        # Sync
        "catalog": lambda s, d: _catalog(s, d),
        "references_by_key": lambda s, d: references_by_key(_refs(s, d)),
        "missing_keys": lambda s, d: sync.missing_keys(_refs(s, d), _catalog(s, d)),
        "unused_keys": lambda s, d: sync.unused_keys(_refs(s, d), _catalog(s, d)),
        "untranslated_keys": lambda s, d: sync.untranslated_keys(_refs(s, d), _catalog(s, d)),
        "empty_values": lambda s, d: sync.empty_values(_refs(s, d), _catalog(s, d)),
        "suspicious_refs": lambda s, d: sync.suspicious_refs(_refs(s, d).withColumn("key", F.coalesce("fallback_literal", "key"))),
        "audit_key_value": lambda s, d: sync.key_value_audit(_refs(s, d), _named_by_text(s, d)),
        "recover_value": lambda s, d: sync.recovered_values(_refs(s, d).withColumn("key", F.concat(F.lit("app."), F.col("key"))), _catalog(s, d)),
        "expand_dynamic": lambda s, d: sync.expanded_keys(_patterns(s)),
        "dynamic_coverage": lambda s, d: sync.dynamic_coverage(_patterns(s), _catalog(s, d)),
        "glob_assumed": lambda s, d: sync.glob_assumed_keys(_catalog(s, d), list(GLOBS)),
        "key_gaps": lambda s, d: sync.key_gaps(_catalog(s, d)),
        "seed_targets": lambda s, d: sync.seeded_targets(_catalog(s, d), seed="[TODO]"),
        "scoped_sync": lambda s, d: sync.missing_keys(sync.scoped(_refs(s, d), _refs(s, d).where(expressions.path_matches(F.col("file_path"), ["**/*.vue"]))), _catalog(s, d)),
        "applied_catalog": lambda s, d: _changed_catalog(s, d),
        "locale_diff": lambda s, d: sync.locale_diff(_catalog(s, d), translate.written(_catalog(s, d), table(s, d, "csv_rows", "key", "target_locale", "translated_value"))),
        "locale_preview": lambda s, d: sync.locale_preview(_catalog(s, d), _changed_catalog(s, d)),
        "actionable_items": lambda s, d: rollup.actionable_items(_refs(s, d), _catalog(s, d)),
        "items_by_kind": lambda s, d: rollup.items_by_kind(rollup.actionable_items(_refs(s, d), _catalog(s, d))),
        "severity_counts": lambda s, d: rollup.severity_counts(rollup.actionable_items(_refs(s, d), _catalog(s, d))),
        # Quality
        "key_equals_value": lambda s, d: _named_by_text(s, d).select("locale", "key", keys.suspicion_with_value(F.col("key"), F.col("value")).alias("reason")).where("reason is not null"),
        "duplicate_values": lambda s, d: quality.duplicate_values(_catalog(s, d)),
        "duplicate_members": lambda s, d: quality.duplicate_members(_catalog(s, d)),
        "orphaned_namespaces": lambda s, d: quality.orphaned_namespaces(_catalog(s, d).withColumn("key", F.concat(keys.last_segment(F.col("key")), F.lit("."), F.col("key")))),
        "inconsistent_prefixes": lambda s, d: quality.inconsistent_prefixes(_catalog(s, d).unionByName(_catalog(s, d).withColumn("key", F.regexp_replace("key", r"^editor\.", "authentication.")))),
        "namespace_case_variants": lambda s, d: quality.namespace_case_variants(_keys(s, d)),
        "locale_consistency": lambda s, d: sync.locale_consistency(_catalog(s, d)),
        "locale_audit": lambda s, d: quality.audit_totals(_catalog(s, d)),
        # Translation
        "translation_plan": lambda s, d: translate.plan(_catalog(s, d)),
        "plan_totals": lambda s, d: translate.plan_totals(translate.plan(_catalog(s, d))),
        "reuse_suggestion": lambda s, d: translate.reuse_suggestions(_handed_over(s, d)),
        "plan_chunks": lambda s, d: translate.chunked(translate.plan(_catalog(s, d))),
        "executed_plan": lambda s, d: translators.executed(translate.plan(_catalog(s, d)), translators.load("pseudo")),
        "csv_export": lambda s, d: translate.csv_records(translate.exported(translate.plan(_catalog(s, d)))),
        "write_actions": lambda s, d: translate.write_actions(_catalog(s, d), table(s, d, "csv_rows", "key", "target_locale", "translated_value")),
        "write_totals": lambda s, d: translate.write_totals(translate.write_actions(_catalog(s, d), table(s, d, "csv_rows", "key", "target_locale", "translated_value"))),
        "value_matrix": lambda s, d: translate.value_matrix(_catalog(s, d)),
        "legacy_values": lambda s, d: translate.legacy_values(table(s, d, "refs", "key", "ord").select(F.col("ord").alias("cand_id"), F.concat(F.lit(" "), F.col("key"), F.lit("\t")).alias("text")), _catalog(s, d)),
        # Renames and candidates
        "rename_proposals": lambda s, d: rename.proposals(_refs(s, d).unionByName(_refs(s, d).withColumn("key", F.concat(F.lit("Save The Report "), F.col("col_no").cast("string")))), _catalog(s, d)),
        "rename_preview": lambda s, d: rename.rename_preview(_mappings(s, d), _catalog(s, d)),
        "rename_occurrences": lambda s, d: rename.occurrences(_catalog(s, d).select(F.col("value").alias("from_key")).distinct(), _candidates(s, d)),
        "renamed_catalog": lambda s, d: rename.renamed(_catalog(s, d), _mappings(s, d)),
        "prefix_collisions": lambda s, d: rename.prefix_collisions(catalog(table(s, d, "locale_catalog", "locale", "key", "value", "ord").withColumn("key", F.substring_index("key", ".", 1)).unionByName(table(s, d, "locale_catalog", "locale", "key", "value", "ord")))),
        "duplicate_status": lambda s, d: rename.duplicate_status(_candidates(s, d)),
        "candidate_dedupe": lambda s, d: rename.candidate_dedupe(_candidates(s, d)),
        "allocated_hashes": lambda s, d: rename.allocated_hashes(_candidates(s, d), 5),
        # Edits
        "edit_conflicts": lambda s, d: edits.conflicts(_edits(s, d)),
        "edit_plan": lambda s, d: edits.planned(_edits(s, d)),
        "rollback_offsets": lambda s, d: edits.rollback_offsets(_edits(s, d)),
        # Extraction
        "source_references": lambda s, d: extract.references(_fragments(s, d)),
        "fallback_literals": lambda s, d: extract.fallback_literals(_fragments(s, d)),
        "html_fragments": lambda s, d: extract.html_fragments(_texts(s, d)),
        "html_attributes": lambda s, d: extract.html_attributes(_texts(s, d)),
        "vue_expr_class": lambda s, d: extract.expressions(_fragments(s, d)),
        "template_split": lambda s, d: extract.template_parts(_fragments(s, d)),
        "template_syntax": lambda s, d: extract.template_syntax_issues(table(s, d, "csv_rows", "row_id", "translated_value"), "translated_value", "row_id"),
        "interpolations": lambda s, d: extract.interpolations(table(s, d, "scan_candidates", "cand_id", "interpolation")),
        "attribute_rules": lambda s, d: extract.html_attributes(_texts(s, d)).select("attribute").distinct().select("attribute", expressions.is_translatable_attribute(F.col("attribute")).alias("translatable")),
        "text_filter_attributes": lambda s, d: extract.html_attributes(_texts(s, d)).select("cand_id", "attribute", "value", texts.skip_reason(F.col("value"), attribute=F.col("attribute")).alias("reason")),
        "html_strings": _by_text(lambda t: {"is_html": expressions.is_html(t)}),
        "expression_reasons": lambda s, d: _texts(s, d).select("cand_id", expressions.expression_reason(F.col("text")).alias("reason"), expressions.template_reason(F.col("text")).alias("template_reason")).where("reason is not null or template_reason is not null"),
        "concat_split": lambda s, d: extract.concatenations(spread(_fragments(s, d))),
        "snippets": lambda s, d: _fragments(s, d).where("text is not null").select("cand_id", expressions.snippet(F.col("text")).alias("snippet"), expressions.preview(F.col("text")).alias("preview")),
        "literal_patterns": _by_key(lambda k: {"pattern": expressions.literal_pattern(k)}),
        "assumed_patterns": lambda s, d: extract.templates(_fragments(s, d)).where(F.col("body").contains("${")).select("cand_id", "template", expressions.assumption(F.col("body")).alias("pattern")),
        "matched_files": lambda s, d: project.matched_files(table(s, d, "scan_candidates", "file_path"), list(INCLUDE), list(EXCLUDE)),
        "pattern_matches": lambda s, d: project.pattern_matches(table(s, d, "scan_candidates", "file_path"), list(INCLUDE), list(EXCLUDE)),
        "translation_usage": lambda s, d: project.translation_usage(table(s, d, "scan_candidates", "file_path", "text")),
        "file_extensions": lambda s, d: project.extensions(_refs(s, d)),
        "source_language": lambda s, d: project.source_language(_catalog(s, d)),
        # Calls by the lexer
        "call_positions": lambda s, d: calls.references(calls.scanned(_fragments(s, d).where(~F.col("text").contains("`")))),
        "dynamic_keys": lambda s, d: calls.dynamic_keys(_calls(s, d)),
        "member_calls": lambda s, d: calls.scanned(_fragments(s, d), ("t", "$t"), members=True),
        "whitelist_suggestions": lambda s, d: calls.whitelist_suggestions(calls.dynamic_keys(_calls(s, d))),
        "bound_attributes": lambda s, d: extract.bound_attributes(_fragments(s, d)),
        "static_paths": _by_text(lambda t: {"path": config.static_path(t)}),
        "without_openers": _by_text(lambda t: {"bare": expressions.without_openers(t)}),
        "variable_names": lambda s, d: extract.interpolations(table(s, d, "scan_candidates", "cand_id", "interpolation")).select("cand_id", "pos", extract.variable_name(F.col("expression")).alias("name")),
        "key_components": _by_key(lambda k: {"component": expressions.is_component(k, F.lit("title"))}),
        "key_collisions": lambda s, d: report.resolved_keys(table(s, d, "scan_candidates", "suggested_key").select(F.col("suggested_key").alias("key")), _catalog(s, d)),
        # Mark-up of components: what is extracted, under which key, and the sources rewritten
        "markup_candidates": lambda s, d: markup.candidates(_sources(s, d)),
        "transform_plan": lambda s, d: markup.planned(_sources(s, d), _catalog(s, d)),
        "transform_status": lambda s, d: markup.status_counts(markup.planned(_sources(s, d), _catalog(s, d))),
        "rewritten_sources": lambda s, d: markup.rewritten(_sources(s, d), markup.planned(_sources(s, d), _catalog(s, d))),
        # Reports
        "exit_code": lambda s, d: report.strict_exit(_items(s, d)),
        "drift_stats": lambda s, d: report.drift_stats(_items(s, d)),
        "health": lambda s, d: report.health(_items(s, d)),
        "unique_items": lambda s, d: report.unique_items(_doubled(_items(s, d))),
        "file_issues": lambda s, d: report.file_issues(_refs(s, d), _catalog(s, d)),
        "coverage": lambda s, d: report.coverage(_catalog(s, d)),
        "quality_report": lambda s, d: report.quality_report(_catalog(s, d)),
        "equal_catalogs": lambda s, d: report.equal_catalogs(_catalog(s, d), translate.written(_catalog(s, d), table(s, d, "csv_rows", "key", "target_locale", "translated_value"))),
        "shape_guess": lambda s, d: report.shape_guess(_catalog(s, d)),
        "pattern_advice": lambda s, d: report.pattern_advice(_file_patterns(s, d)),
        "requested_locales": lambda s, d: report.requested_locales(_catalog(s, d), ["de", "ja", "xx"]),
        "report_json": lambda s, d: report.as_json(_items(s, d)),
        "report_markdown": lambda s, d: report.markdown_summary(rollup.items_by_kind(_items(s, d))),
        "newest_crawls": lambda s, d: report.newest(table(s, d, "documents", "doc_id", "project").where("project is not null").groupBy("project").agg(F.max("doc_id").alias("last")), "last"),
        # Configuration values, command lines, places
        "config_safety": lambda s, d: _settings(s, d).select("value", config.is_unsafe(F.col("value")).alias("unsafe"), *[config.is_like(F.col("value"), p).alias(n) for n, p in (("language_tag", config.LANGUAGE_TAG), ("identifier", config.IDENTIFIER), ("namespace", config.NAMESPACE))], config.path_problem(F.col("value")).alias("path_problem")),
        "config_values": lambda s, d: table(s, d, "import_rows", "imp_id", "translated_value").where("translated_value is not null").select("imp_id", config.value_kind(F.col("translated_value")).alias("kind"), config.plain_value(F.col("translated_value")).alias("plain"), F.array_join(config.string_list(F.col("translated_value")), "|").alias("listed"), F.array_join(config.path_parts(F.col("translated_value")), "/").alias("path")),
        "positive_integers": lambda s, d: _refs(s, d).select("key").unionByName(_refs(s, d).select(F.concat(F.lit("n."), F.col("line").cast("string")).alias("key"))).distinct().select("key", config.positive_integer(keys.last_segment(F.col("key"))).alias("n"), config.clamped(keys.last_segment(F.col("key"))).alias("clamped")),
        "command_words": _by_text(lambda t: {"words": F.array_join(config.command_tokens(t), "\x1f")}),
        "small_signs": _by_text(lambda t: {"entity": config.is_like(t, config.HTML_ENTITY), "hex_colour": config.is_like(t, config.HEX_COLOUR), "repeated": t.rlike(r"^([^\p{L}\d\s])\1+\z")}),
        "text_places": lambda s, d: _texts(s, d).withColumn("at", F.expr("instr(text, \"'\") - 1")).where("at >= 0").select("cand_id", config.line_of(F.col("text"), F.col("at")).alias("line"), config.column_of(F.col("text"), F.col("at")).alias("col")),
        "normal_locales": lambda s, d: table(s, d, "import_rows", "target_locale").where("target_locale is not null").distinct().select(F.col("target_locale").alias("label"), translate.normalized_locale(F.col("target_locale")).alias("locale")),
        "event_ages": lambda s, d: _events(s, d).select("event_id", config.relative_age(F.col("ts"), _events(s, d).agg(F.max("ts").alias("m")).scalar()).alias("age")),
        "cache_reasons": lambda s, d: project.invalidation_reasons(_headers(s, d), {"version": "1", "identifier": "t", "config_hash": "c0", "tool_version": "v2"}).select("event_id", "reasons"),
        "catalog_files": _through_files,
        # Rollups of events, incremental work
        "cache_hit_rate": lambda s, d: rollup.hit_rates(_events(s, d).select(F.col("event_type").alias("kind"), (F.col("value") > 50).alias("hit"))),
        "framework_confidence": lambda s, d: rollup.framework_confidence(_events(s, d).select(F.concat(F.col("event_type"), F.col("user_id").cast("string")).alias("framework"), F.round(F.col("value") / 1000, 3).alias("weight"))),
        "file_fingerprints": lambda s, d: changes.file_fingerprints(_refs(s, d)),
        "incremental_refs": lambda s, d: changes.incremental(changes.file_fingerprints(_refs(s, d)), changes.file_fingerprints(_refs(s, d).select("file_path", "key", "line", "col_no").distinct())).select("file_path", "action"),
        "debounce_sessions": lambda s, d: changes.debounced(_events(s, d).select(F.col("event_type").alias("trigger"), "ts")),
        "circuit_breaker": lambda s, d: changes.breaker(_events(s, d).select(F.col("user_id").alias("stream"), "ts", F.col("event_id").alias("ord"), (F.col("value") < 40).alias("failed"))),
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | oracles_report.oracle_sql()

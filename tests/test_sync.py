import itertools

import pytest

from lexiloom.operators import quality, rename, rollup, sync, translate
from lexiloom.sources.relations import catalog, references_by_key

REFS = "key string, file_path string, line int, col_no int, fallback_literal string, ord long"
RAW = "locale string, key string, value string, ord long, extra string"


@pytest.fixture(scope="module")
def refs(spark):
    rows = [("a.x", "f1", 1, 1, None, 2), ("a.x", "f2", 2, 2, "Ex", 1), ("new.key", "f1", 3, 1, "New", 3), ("a.blank", "f1", 4, 1, None, 4), (None, "f1", 5, 1, None, 5), ("root.old.name", "f1", 6, 1, None, 6)]
    return spark.createDataFrame(rows, REFS)


@pytest.fixture(scope="module")
def cat(spark):
    rows = [("en", "a.x", "old", 1, "e"), ("en", "a.x", "X {{n}}", 2, "e"), ("en", "a.blank", " ", 3, "e"), ("en", "unused.k", "U", 4, "e"), ("de", "unused.k", " ", 5, "e"), ("de", "a.x", "X", 6, "e"), ("fr", "a.x", "TODO", 7, "e"), ("en", "old.name", "Name", 8, "e"), (None, "z", "z", 9, "e"), ("pt", "a.x", None, 10, "e"), ("pt-BR", "unused.k", "U", 11, "e")]
    return catalog(spark.createDataFrame(rows, RAW))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_catalog_last_counts(cat):
    got = {(r.locale, r.key): r.value for r in cat.collect()}
    assert got["en", "a.x"] == "X {{n}}" and got["pt", "a.x"] == "" and len(got) == 9


def test_references(refs):
    r = {x.key: x for x in references_by_key(refs).collect()}
    assert (r["a.x"].n_references, r["a.x"].first_file, r["a.x"].fallback) == (2, "f2", "Ex") and None not in r


def test_missing(refs, cat):
    assert [(r.key, r.fallback) for r in sync.missing_keys(refs, cat).orderBy("key").collect()] == [("a.blank", None), ("new.key", "New"), ("root.old.name", None)]
    assert {r.key for r in sync.missing_keys(refs, cat, ignore_empty=True).collect()} == {"new.key", "root.old.name"}


def test_unused_and_untranslated(refs, cat):
    assert rows(sync.unused_keys(refs, cat).select("key", "locales")) == [("old.name", "en"), ("unused.k", "en,pt-BR")]
    assert rows(sync.untranslated_keys(refs, cat).select("key", "locales")) == [("unused.k", "de")]


def test_lookups(refs, cat):
    assert rows(sync.placeholder_issues(cat)) == [("a.x", "de", "n", ""), ("a.x", "fr", "n", ""), ("a.x", "pt", "n", "")]
    assert rows(sync.empty_values(refs, cat)) == [("a.x", "fr", "placeholder", "Ex"), ("a.x", "pt", "empty", "Ex"), ("unused.k", "de", "whitespace", None)]
    assert rows(sync.recovered_values(refs, cat)) == [("root.old.name", "old.name", "Name")]


def test_applied(refs, cat):
    got = {(r.locale, r.key): r.value for r in sync.applied(refs, cat).collect()}
    assert got["en", "new.key"] == "New" and got["en", "root.old.name"] == "Name" and got["en", "a.blank"] == "Blank"
    assert ("en", "unused.k") not in got and ("de", "unused.k") in got and got["fr", "new.key"] == ""


def test_dynamic(spark, cat):
    p = spark.createDataFrame([("a.*", ["x", "y"]), ("plain", []), ("b.*", [])], "pattern string, values array<string>")
    assert rows(sync.expanded_keys(p)) == [("a.*", "a.x"), ("a.*", "a.y")]
    assert {(r.locale, r.n_missing) for r in sync.dynamic_coverage(p, cat).where("pattern = 'a.*'").collect()} == {("en", 1), ("de", 1), ("fr", 1), ("pt", 1), ("pt-BR", 2)}


def test_diff(cat):
    before, after = cat.where("key <> 'unused.k'"), cat.where("key <> 'old.name'")
    assert {r.change for r in sync.locale_diff(before, after).collect()} == {"added", "removed"}
    assert rows(sync.locale_preview(before, after)) == [("de", 1, 0), ("en", 1, 1), ("pt-BR", 1, 0)]


def test_naming_fold(spark):
    import random

    random.seed(3)
    parts = ["save", "saveAll", "save-all", "save_all", "1.2"]
    data = [(loc, f"{i:04d}.{random.choice(parts)}") for loc in "ab" for i in range(300)]
    want = {}
    for loc in "ab":
        votes = {"kebab-case": 0, "camelCase": 0, "snake_case": 0}
        for _, k in sorted(x for x in data if x[0] == loc):
            tail = k.split(".")[-1]
            if not any(c.isalpha() for c in tail):
                continue
            form = "kebab-case" if "-" in tail else "snake_case" if "_" in tail else "camelCase" if any(a.islower() and b.isupper() for a, b in itertools.pairwise(tail)) else None
            top = max(votes.values())
            votes[form or (next(n for n, v in votes.items() if v == top) if top else "kebab-case")] += 1
        want[loc] = max(votes, key=votes.get)
    got = {r.locale: r.convention for r in quality.naming_convention(spark.createDataFrame(data, "locale string, key string").repartition(3)).collect()}
    assert got == want


def test_translation(spark, cat):
    plan = translate.plan(cat)
    assert {(r.key, r.locale) for r in plan.collect()} >= {("a.x", "fr"), ("unused.k", "de"), ("old.name", "de")} and not plan.where("key = 'a.x' and locale = 'de'").count()
    assert [tuple(r) for r in translate.csv_records(spark.createDataFrame([('a,"b"', None)], "x string, y string")).collect()] == [('"a,""b""",',)]
    updates = spark.createDataFrame([("a.x", "de", "X"), ("a.x", "fr", "Y"), ("a.x", "pt", " "), ("unused.k", "pt-BR", "V"), (None, "de", "x")], "key string, target_locale string, translated_value string")
    assert rows(translate.write_actions(cat, updates)) == [("a.x", "de", "unchanged"), ("a.x", "fr", "write"), ("a.x", "pt", "skip-empty"), ("unused.k", "pt-BR", "skip-existing")]


def test_rename(spark, cat):
    refs = spark.createDataFrame([("Save it", "f", 1, 1, None, 1), ("Save It", "f", 1, 1, None, 2), ("Found", "f", 1, 1, None, 3)], REFS)
    got = {r.key: (r.proposed, r.conflict) for r in rename.proposals(refs, cat).collect()}
    assert got == {"Save It": ("common.save-it", None), "Save it": ("common.save-it", "repeated"), "Found": ("common.found", None)}
    m = spark.createDataFrame([("a.x", "a.y"), ("old.name", "a.x")], "from_key string, to_key string")
    assert ("old.name", "a.x", "en", False, True) in rows(rename.rename_preview(m, cat))
    assert {(r.key, r.outcome) for r in rename.renamed(cat, m).where("locale = 'en'").collect()} >= {("a.y", "renamed"), ("old.name", "duplicate")}


def test_empty_tables(spark):
    refs, cat = spark.createDataFrame([], REFS), catalog(spark.createDataFrame([], RAW))
    for df in (sync.missing_keys(refs, cat), sync.unused_keys(refs, cat), sync.placeholder_issues(cat), sync.key_gaps(cat), quality.duplicate_values(cat), translate.plan(cat), quality.inconsistent_prefixes(cat), quality.naming_convention(cat)):
        assert df.collect() == []
    assert tuple(rollup.severity_counts(rollup.actionable_items(refs, cat)).collect()[0]) == (0, 0, 0, "none", 0)

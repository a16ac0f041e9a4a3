import itertools
import random
import unicodedata

import pytest

from lexiloom.llm import formatdup, lookalikes

CSV = "row_id long, key string, source_value string, target_locale string, head long, canon string"
CAND = "cand_id long, suggested_key string, text string, part int"


def fold(s):
    out = "".join(c for c in s.upper().lower() if not (unicodedata.category(c)[0] in "PZC" or c.isspace() or c in "|`´^¨=<>~"))
    return out or "".join(s.split())


def canon(text):
    import re

    for sep in (r"[;|/•,]", r"[\r\n]+"):
        parts = [p for p in re.split(sep, text.upper().lower()) if re.search(r"\w", p)]
        if len(parts) > 1 and all(re.match(r"[^:]*\w[^:]*:", p) for p in parts):
            return sorted((fold(p.split(":", 1)[0]), fold(p.split(":", 1)[1])) for p in parts)
    return fold(text)


def test_copies_against_brute_force(spark):
    random.seed(2)
    texts = ["Plan: Team; Seats: 40; Limit: 106", "Plan: Team; Seats: 106; Limit: 40", "limit:106 | PLAN:team | seats : 40", "Seats: 40\nPlan: Team\nLimit: 106", "Save the page.", "  save THE page", "«Save the page»", "Saved page", "Straße", "STRASSE", "x²", "x", "", "???", "—", "You: see; this is a sentence"]
    keys = ["a.b-c", "A/B_C", " a b.c", "ab.d"]
    rows = [(i, random.choice(keys), random.choice(texts), random.choice(["de", "fr"]), 1, "c") for i in range(1, 700)]
    rows += [(1000 + i, "hot.key", "Hot text", "de", 1, "c") for i in range(400)] + [(2000, None, "x", "de", 1, "c"), (2001, "a", None, "de", 1, "c"), (2002, "a", "x", None, 1, "c")]
    groups = {}
    for i, k, t, loc, *_ in rows:
        if None not in (k, t, loc):
            groups.setdefault((loc, fold(k), str(canon(t))), []).append(i)
    want = {("csv_rows", min(g), i) for g in groups.values() for i in g if i != min(g)}
    records = formatdup.csv_records(spark.createDataFrame(rows, CSV).repartition(5))
    # Without coalescing, the hot group spreads over several partitions and is stitched.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r) for r in formatdup.copies(records).collect()}
        reps = {r.id: r.n_copies for r in formatdup.representatives(records).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want
    assert reps == {min(g): len(g) for g in groups.values()}


def test_candidates_and_empty(spark):
    long = "word " * 60_000
    df = spark.createDataFrame([(3, "k.a", long, 1), (2, "K-A", long.upper() + "!", 1), (1, "k.a", "other", 1)], CAND)
    records = formatdup.candidate_records(df)
    assert [tuple(r) for r in formatdup.copies(records).collect()] == [("scan_candidates", 2, 3)]
    empty = formatdup.candidate_records(df.where("false"))
    assert formatdup.copies(empty).collect() == [] and formatdup.representatives(empty).collect() == []


def frame(spark, rows):
    t = spark.createDataFrame([(i, x, "l") for i, x in rows], "cand_id long, text string, look string")
    return lookalikes.texts({"scan_candidates": (t, "cand_id", "text")})


def test_same_look(spark):
    same = ["Save the file", "Savе the file", "Save the file", "﻿Save the file", "Ｓａｖｅ the file", "Save the ﬁle", "Sa­ve the file"]
    rows = list(enumerate(same, 1)) + [(20, "Save the file"), (30, "save the file"), (31, "Save  the file"), (32, "Save the file²"), (33, "Save the file."), (40, "???"), (41, "？？？"), (42, None), (43, ""), (50, "é"), (51, "é"), (60, "ガ"), (61, "ｶﾞ"), (70, "a-b"), (71, "a‑b"), (80, "Отмена"), (81, "Oтмена"), (90, "ё"), (91, "ë"), (95, "y" * 200_000), (96, "y" * 200_000 + "​")]
    group = {**dict(enumerate(same, 1)), 20: "Save the file"}
    want = {(a, b) for a, b in itertools.combinations(sorted(group), 2) if group[a] != group[b]}
    want |= {(50, 51), (60, 61), (70, 71), (80, 81), (90, 91), (95, 96)}
    got = [tuple(r) for r in lookalikes.same_look(frame(spark, rows)).select("id_a", "id_b").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    forms = {r.id: r.text for r in lookalikes.consistent(frame(spark, rows)).collect()}
    assert {forms[i] for i in group} == {"Save the file"} and forms[42] is None and forms[32].endswith("²") and len(forms) == len(rows)


def test_hot_spelling_is_salted(spark, monkeypatch):
    monkeypatch.setattr(lookalikes, "SALT_ROWS", 10)
    rows = [(i, "Loading") for i in range(1, 95)] + [(i, "Lоading") for i in range(200, 230)] + [(300, "Loading​")]
    got = [tuple(r) for r in lookalikes.same_look(frame(spark, rows)).select("id_a", "id_b").collect()]
    assert sorted(got) == sorted([(i, j) for i in range(1, 95) for j in (*range(200, 230), 300)] + [(j, 300) for j in range(200, 230)])


def test_readable_forms(spark):
    stay = ["エラーが発生しました", "Вход в систему", "Отмена, ёлка", "工業の力", "Αθήνα", "naïve café", "日本一"]
    pairs = [("Oтмeнa", "Отмена"), ("Sаvе", "Save"), ("工ラ一", "エラー"), ("ｶﾞｲﾄﾞ", "ガイド"), ("Aθήvα", "Αθήνα")]
    rows = list(enumerate([*stay, *[a for a, _ in pairs]]))
    got = {r.id: r.text for r in lookalikes.consistent(frame(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == [*stay, *[b for _, b in pairs]]


def test_empty(spark):
    assert lookalikes.same_look(frame(spark, [])).collect() == [] and lookalikes.consistent(frame(spark, [])).collect() == []


@pytest.mark.parametrize("images", [lookalikes.widths(), lookalikes.shapes()])
def test_images_are_stable(images):
    assert all(images.get(c, c) == c for image in images.values() for c in image)

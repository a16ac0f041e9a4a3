import random
import re

import pytest

from lexiloom.operators.rejects import classify, loaded, rejected

LINES = "line_id long, file_name string, line_no int, raw string, delimiter string, reason string"
LOCALES = [("en",), ("de",), ("pt-BR",)]


def frame(spark, rows):
    # `delimiter` and `reason` are extra columns whose names clash with inner ones.
    return spark.createDataFrame([(i, f, n, r, "x", "y") for i, f, n, r in rows], LINES)


def locales(spark):
    return spark.createDataFrame(LOCALES, "locale string")


def parse(record, delimiter):
    """Fields of a record, or None where its quoting is broken: a character-level automaton."""
    fields, i, n = [], 0, len(record)
    while True:
        if i < n and record[i] == '"':
            i, out = i + 1, []
            while True:
                if i >= n:
                    return None
                if record[i] == '"':
                    if i + 1 < n and record[i + 1] == '"':
                        out.append('"')
                        i += 2
                        continue
                    i += 1
                    break
                out.append(record[i])
                i += 1
            if i < n and record[i] != delimiter:
                return None
            fields.append("".join(out))
        else:
            j = record.find(delimiter, i)
            j = n if j < 0 else j
            if '"' in record[i:j]:
                return None
            fields.append(record[i:j])
            i = j
        if i >= n:
            return fields
        i += 1
        if i == n:
            return [*fields, ""]


def expected(record, delimiter, names):
    record = record[:-1] if record.endswith("\r") else record
    fields = parse(record, delimiter)
    if fields is None:
        return "quoting"
    if len(fields) != len(names):
        return "column_count"
    v = dict(zip(names, fields))
    key = v["key"].strip()
    if not re.fullmatch(r"[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)*", key) or v["targetLocale"].strip().lower().replace("_", "-") not in {x[0].lower() for x in LOCALES}:
        return "invalid_value"
    text = v["translatedValue"]
    if re.search("[�\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", text) or text.strip() in ("#REF!", "#NAME?", "#VALUE!", "#N/A", "#DIV/0!"):
        return "invalid_value"
    return None


def test_against_an_automaton(spark):
    random.seed(7)
    rows, want, i = [], {}, 0
    dialects = {"a.csv": (",", ["key", "targetLocale", "translatedValue"], "﻿key,targetLocale,translatedValue"), "b.csv": (";", ["note", "translatedValue", "key", "targetLocale"], '"note";"translatedValue";"key";"targetLocale"\r'), "c.csv": ("\t", ["targetLocale", "key", "translatedValue"], "targetLocale\tkey\ttranslatedValue")}
    pieces = ["a.b", "x", '"', '""', ",", ";", "\t", "de", "pt_br", " ", "\n", "#REF!", "\x07", "�", "é", "a..b", '"q"', '"a;b,c\td"']
    for f, (d, names, head) in dialects.items():
        i += 1
        rows.append((i, f, 1, head))
        for n in range(400):
            i += 1
            if n % 2:
                record = d.join(random.choice(['"a.b"', "a.b", "de", '"pt-BR"', "x y", '""', "", '"a""b"', '"l\nm"', "de"]) for _ in names)
            else:
                record = "".join(random.choice([*pieces, d, d]) for _ in range(random.randint(1, 8)))
            record += random.choice(["", "", "\r"])
            rows.append((i, f, n + 2, record))
            if record.strip():
                want[i] = expected(record, d, names)
    got = {r.line_id: r.reason for r in classify(frame(spark, rows), locales(spark)).collect()}
    assert got == want
    assert len({v for v in want.values()}) == 4


def test_values_and_defined_results(spark):
    long = "y" * 300_000
    rows = [
        (1, "a.csv", 1, "key,targetLocale,translatedValue"),
        (2, "a.csv", 2, None),
        (3, "a.csv", 3, " \t "),
        (4, "a.csv", 4, f'a.b,de,"{long} ""q"", z"'),
        (5, "a.csv", 5, "a.b,de,plain"),
        (6, "a.csv", 5, "a.b,de,plain"),
        (7, "a.csv", 6, "\r"),
        (8, "a.csv", 7, " a.b , DE ,"),
        (9, "none.csv", 2, "a.b,en,Hello,de,Hallo"),
    ]
    out = {r.line_id: r for r in loaded(frame(spark, rows), locales(spark)).collect()}
    assert set(out) == {4, 5, 6, 8, 9}
    assert out[4].translated_value == long + ' "q", z'
    assert (out[8].key, out[8].target_locale, out[8].translated_value) == ("a.b", "de", "")
    assert out[9].translated_value == "Hallo" and out[9].source_value == "Hello"


def test_wide_headers_take_the_exact_way(spark):
    names = [f"n{i}" for i in range(60)] + ["key", "targetLocale", "translatedValue"]
    rows = [(1, "w.csv", 1, ",".join(names)), (2, "w.csv", 2, ",".join(["x"] * 60 + ["a.b", "de", '"t,u"'])), (3, "w.csv", 3, "a,b")]
    out = {r.line_id: (r.reason, r.translated_value) for r in classify(frame(spark, rows), locales(spark)).collect()}
    assert out == {2: (None, "t,u"), 3: ("column_count", None)}


def test_empty_table(spark):
    assert rejected(frame(spark, []), locales(spark)).collect() == []


@pytest.mark.parametrize("query", ["p3_found", "p3_loaded"])
def test_registered(spark, data, query):
    from lexiloom.plans.queries import queries

    assert queries()[query](spark, data).count() > 0

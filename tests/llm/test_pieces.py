"""Problem 2 reads every piece before its shape may drop it."""

from lexiloom.llm import codetext
from tests.llm.samples import documents, lines


def test_wording_with_the_shape_of_code(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, lang string, text string")
    base = "const cls = \"flex items-center gap-2 text-sm\";\nconst q = 'SELECT id, title FROM billing WHERE id = ?';\nimport { x } from '@/lib/y';\n// eslint-disable-next-line no-unused-vars"
    en = lines("en")[9].removesuffix(".")
    told = [f"{en}(s)", f"Update {en} and set it.", f"{en} in İstanbul.", "SELECT id, title FROM billing WHERE id = ?"]
    rows = [(k, "f", "jsx-expression", base) for k in range(100, 140)] + [(i, "f", "call-expression", f'f("{t}")') for i, t in enumerate(told)]
    df = spark.createDataFrame(rows, "cand_id long, file_path string, kind string, text string")
    assert {tuple(r) for r in codetext.found(df, docs).collect()} == {(i, "literal", "en") for i in range(3)}


def test_lower_case_keeps_the_length():
    assert codetext.emission_form("İstanbul 12") == "istanbul 00"

"""Problem 5: one consistent form for texts that look the same but differ in their characters.

DuckDB runs inside each Arrow partition; the mapping is embedded SQL made of `nfc_normalize`, `translate`, `replace` and
regular expressions. It has two steps: a look, in which every shape has one code point, for comparing; and from the look
alone a readable text, whose words of Cyrillic, Greek or Katakana letters get back all their letters of that script. The pairs are found on fixed-size digests: only groups that hold at least two spellings are kept, their
distinct spellings are joined with each other (never their rows), and rows are attached to the pairs of spellings last.

What looks the same: width forms, ligatures, composed or decomposed accents, invisible characters, kinds of blank or
hyphen, letters of other scripts that have the shape of a Latin letter, and kana that have the shape of an ideograph.
Letter case, accents, raised figures, punctuation and the number and place of ordinary blanks stay as they are.

Defined results
* null text: consistent text null, in no pair. Empty text, and texts without a letter or digit: changed like any other,
  in no pair. Repeated rows: equal texts are never a pair of each other, each is a pair with every other spelling.
* empty tables give empty results; further columns are ignored. Texts of any length are handled whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.storage import materialize

# Shapes shared with Latin letters.
CYRILLIC = ("АВЕКМНОРСТУХЅІЈԚԜҮӀаеорсухѕіјԁһԛԝүӏ", "ABEKMHOPCTYXSIJQWYIaeopcyxsijdhqwyl")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳαινορυγϲκ", "ABEZHIKMNOPTYXCjaivopuyck")
ARMENIAN = ("ՍՕօսհոցզ", "UOouhngq")
LATIN = ("ɡɑ", "ga")
KANA = ("エカタトニハロチヘべぺー", "工力夕卜二八口千へベペ一")
# Kinds of blank, kinds of hyphen, and the ranges of characters that show nothing.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\u2012\u2043\u02d7\u2212\u058a\ufe63\uff0d"
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}]"
SALT_ROWS = 20_000


@cache
def widths() -> dict[str, str]:
    """By rule from the Unicode data: width forms, ligatures and Roman numerals to their compatibility form."""
    out = {}
    for code in (*range(0x132, 0x1F4), *range(0x2160, 0x2180), *range(0xFB00, 0xFB07), *range(0xFE30, 0xFE70), *range(0xFF01, 0xFFEF)):
        kind = unicodedata.decomposition(chr(code)).partition(" ")[0]
        if kind in ("<wide>", "<narrow>", "<small>") or kind == "<compat>" and not 0xFE30 <= code:
            out[chr(code)] = unicodedata.normalize("NFKC", chr(code))
    return out | dict.fromkeys(BLANKS, " ") | dict.fromkeys(HYPHENS, "-")


@cache
def shapes() -> dict[str, str]:
    """Letters of other scripts to the letter of the same shape; composed letters keep their accents."""
    out = {a: b for one, other in (CYRILLIC, GREEK, ARMENIAN, LATIN, KANA) for a, b in zip(one, other, strict=True)}
    for code in range(0x370, 0x530):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in out:
            out[chr(code)] = unicodedata.normalize("NFC", out[parts[0]] + parts[1:])
    return out


@cache
def scripts() -> list[tuple[str, str, str]]:
    """By script: a pattern of its letters that no other script shares, and the shared shapes with the script's own letters.

    Where several letters of a script have one shape, the first stands for it.
    """
    out = []
    for low, high, source in ((0x400, 0x530, CYRILLIC), (0x370, 0x400, GREEK), (0x30A1, 0x30FB, KANA)):
        own = {}
        for a, b in shapes().items():
            if a in source[0] or low <= ord(a) < high and len(b) == 1:
                own.setdefault(b, a)
        letters = [chr(c) for c in range(low, high) if unicodedata.category(chr(c))[0] == "L" and chr(c) not in shapes()]
        out.append((f"[{''.join(letters)}]", "".join(own), "".join(own.values())))
    return out


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _mapped(e: str, images: dict[str, str]) -> str:
    single = {a: b for a, b in images.items() if len(b) == 1}
    e = f"translate({e}, {_quoted(''.join(single))}, {_quoted(''.join(single.values()))})"
    for a, b in images.items():
        if len(b) > 1:
            e = f"replace({e}, {_quoted(a)}, {_quoted(b)})"
    return f"nfc_normalize({e})"


@cache
def look_sql(column: str = "text") -> str:
    """The embedded SQL of the form that equal looks share; ASCII text passes through untouched."""
    e = _mapped(f"regexp_replace(nfc_normalize({column}), '{INVISIBLE}', '', 'g')", widths())
    e = _mapped(e, shapes())
    return f"CASE WHEN {column} IS NULL OR NOT regexp_matches({column}, '[^\\x00-\\x7F]') THEN {column} ELSE {e} END"


@cache
def consistent_sql(look: str = "look") -> str:
    """The embedded SQL of the readable form of a look: words with letters of one script get all their letters from it.

    It depends on the look alone, and has that look itself, so readable forms are equal just where looks are.
    """
    word = "w"
    for pattern, shared, own in reversed(scripts()):
        word = f"CASE WHEN regexp_matches(w, {_quoted(pattern)}) THEN translate(w, {_quoted(shared)}, {_quoted(own)}) ELSE {word} END"
    words = f"regexp_extract_all({look}, '[\\pL\\pM]+|[^\\pL\\pM]+')"
    return f"CASE WHEN {look} IS NULL OR NOT regexp_matches({look}, '[^\\x00-\\x7F]') THEN {look} ELSE nfc_normalize(array_to_string(list_transform({words}, lambda w: {word}), '')) END"


def _duck():
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB"})
    return con


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _duck()
    for b in batches:
        con.register("part", pa.Table.from_batches([b]))
        out = con.sql(f"SELECT tab_name, id, {consistent_sql()} AS text FROM (SELECT tab_name, id, {look_sql()} AS look FROM part)").to_arrow_table()
        yield from out.cast(pa.schema([("tab_name", pa.string()), ("id", pa.int64()), ("text", pa.string())])).to_batches()
        con.unregister("part")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _duck()
    query = f"""
        SELECT tab_name, id, unhex(md5(look)) AS look, unhex(md5(text)) AS spelling
        FROM (SELECT tab_name, id, text, {look_sql()} AS look FROM part)
        WHERE regexp_matches(look, '[\\pL\\pN]')"""
    kinds = pa.schema([("tab_name", pa.string()), ("id", pa.int64()), ("look", pa.binary()), ("spelling", pa.binary())])
    for b in batches:
        con.register("part", pa.Table.from_batches([b]))
        yield from con.sql(query).to_arrow_table().cast(kinds).to_batches()
        con.unregister("part")


def texts(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """tab_name, id, text of several tables, given as name -> (table, id column, text column)."""
    out = None
    for name, (df, id_col, text_col) in tables.items():
        one = df.select(F.lit(name).alias("tab_name"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def consistent(rows: DataFrame) -> DataFrame:
    """tab_name, id, text: every row with its text in the consistent form."""
    return rows.select("tab_name", "id", "text").mapInArrow(_rewrite, "tab_name string, id long, text string")


def same_look(rows: DataFrame) -> DataFrame:
    """tab_name, id_a, id_b: the pairs of rows of one table that differ as code points but look the same.

    The result is as large as the pairs asked for. What is shuffled before is one row of marks per look, then the digests
    once; only rows of looks with several spellings go on. Looks and spellings of more than a thousandth of all rows (and
    `SALT_ROWS`) are a thousand at most; these alone are broadcast, and their rows and pairs are spread over salts.
    """
    kept = rows.select("tab_name", "id", "text").where("text is not null")
    digests = materialize(kept.mapInArrow(_digest, "tab_name string, id long, look binary, spelling binary"), "looks")
    most = max(SALT_ROWS, digests.count() // 1000)
    mark = F.xxhash64("spelling")
    looks = digests.groupBy("tab_name", "look").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    several = _salted(digests, materialize(looks.select("tab_name", "look", "n"), "looks-mixed"), "look", most)
    several = materialize(several.select("tab_name", "id", "look", "spelling"), "looks-mixed-rows")
    spellings = materialize(several.groupBy("tab_name", "look", "spelling").agg(F.count("*").alias("n")), "spellings")
    side = lambda x: spellings.select("tab_name", "look", F.col("spelling").alias(f"spelling_{x}"), F.col("n").alias(f"n_{x}"))
    pairs = side("a").join(side("b"), ["tab_name", "look"]).where("spelling_a < spelling_b").select("tab_name", "spelling_a", "n_a", "spelling_b", "n_b")
    ends = several.select("tab_name", "spelling", "id")
    for x in ("a", "b"):
        hot = F.greatest(F.ceil(F.col(f"n_{x}") / most).cast("int"), F.lit(1))
        pairs = pairs.withColumn("salts", hot).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        own = _with_salts(ends, spellings.select("tab_name", "spelling", "n"), "spelling", most).select("tab_name", F.col("spelling").alias(f"spelling_{x}"), "salt", F.col("id").alias(f"row_{x}"))
        pairs = pairs.join(own, ["tab_name", f"spelling_{x}", "salt"]).drop("salt", "salts")
    return pairs.select("tab_name", F.least("row_a", "row_b").alias("id_a"), F.greatest("row_a", "row_b").alias("id_b"))


def _with_salts(rows: DataFrame, counts: DataFrame, key: str, most: int) -> DataFrame:
    """`rows` with a salt: 0, but for the keys of more than `most` rows, of which there are so few that they're broadcast."""
    hot = counts.where(F.col("n") > most).select("tab_name", key, F.ceil(F.col("n") / most).cast("int").alias("salts"))
    return rows.join(F.broadcast(hot), ["tab_name", key], "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")


def _salted(rows: DataFrame, counts: DataFrame, key: str, most: int) -> DataFrame:
    """The rows whose key is in `counts` (tab_name, key, n); keys of many rows are spread over salts."""
    wanted = counts.select("tab_name", key, F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / most).cast("int"), F.lit(1)) - 1)).alias("salt"))
    return _with_salts(rows, counts, key, most).join(wanted, ["tab_name", key, "salt"], "left_semi")

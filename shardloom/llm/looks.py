"""One form for texts that look alike when displayed but are stored differently (problem 10).

The form is worked out by SQL in an in-process DuckDB that reads each Arrow batch where it lies: invisible characters
go, compatibility forms that differ in width or in how a joined letter pair is stored are unfolded, kinds of blanks
and hyphens become one, look-alike letters of other scripts become Latin ones, and NFC composes accents. Letters are
mapped before and after composition, so that it does not matter whether an accent was stored apart.

Not mapped, as they look different: case, missing or other accents, raised or lowered digits, fractions, line ends,
the number of blanks, and letters that are only similar.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

# Letters of other scripts drawn like a Latin letter, each string aligned with its Latin letters.
CYRILLIC = "АВЕЅІЈКМНОРСТХҮԌԚԜаеѕіјорсухһԁԛԝӏ"
AS_LATIN = "ABESIJKMHOPCTXYGQWaesijopcyxhdqwl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳϲϹ"
AS_LATIN_TOO = "ABEZHIKMNOPTYXojcC"
ARMENIAN_AND_OTHERS = "օՕՍսհզᴏᴄᴠᴡᴢɡ"
AS_LATIN_THREE = "oOUuhqocvwzg"
# Signs drawn alike (micro sign, one-dot leader, ratio).
SIGNS = "\u00b5\u2024\u2236"
AS_SIGNS = "\u03bc.:"
# Kinds of blanks and hyphens, and ranges of characters that show nothing.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\ufe63\u2043\u02d7"
INVISIBLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
#: Blocks of compatibility characters that differ in width only, and of joined letter pairs.
WIDTH_BLOCK, PAIR_BLOCKS = (0xFF01, 0xFFEE), ((0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0xFB00, 0xFB06), (0xFB13, 0xFB17))


def letter_pairs() -> dict[str, str]:
    """Characters mapped to one character each before composition."""
    pairs = dict(zip(CYRILLIC + GREEK + ARMENIAN_AND_OTHERS + SIGNS, AS_LATIN + AS_LATIN_TOO + AS_LATIN_THREE + AS_SIGNS, strict=True))
    pairs |= dict.fromkeys(BLANKS, " ") | dict.fromkeys(HYPHENS, "-")
    for c in map(chr, range(WIDTH_BLOCK[0], WIDTH_BLOCK[1] + 1)):
        wide = unicodedata.normalize("NFKC", c)
        # The half-width voice marks stand for the marks that combine, not for a blank with a mark.
        wide = {"\uff9e": "\u3099", "\uff9f": "\u309a"}.get(c, wide)
        if len(wide) == 1 and wide != c and unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")):
            pairs[c] = pairs.get(wide, wide)
    return pairs


def composed_pairs() -> tuple[dict[str, str], dict[str, str]]:
    """Accented letters whose bare letter is mapped: to one composed character, or to letter and accent."""
    one, more = {}, {}
    bare = dict(zip(CYRILLIC + GREEK + ARMENIAN_AND_OTHERS, AS_LATIN + AS_LATIN_TOO + AS_LATIN_THREE, strict=True))
    for c in map(chr, (*range(0x0370, 0x0530), *range(0x1F00, 0x2000))):
        apart = unicodedata.normalize("NFD", c)
        if len(apart) > 1 and apart[0] in bare:
            whole = unicodedata.normalize("NFC", bare[apart[0]] + apart[1:])
            (one if len(whole) == 1 else more)[c] = whole
    return one, more


def unfolded() -> dict[str, str]:
    """Joined letter pairs and the letters they stand for."""
    return {c: unicodedata.normalize("NFKC", c) for low, high in PAIR_BLOCKS for c in map(chr, range(low, high + 1)) if unicodedata.normalize("NFKC", c) != c}


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _translate(inner: str, pairs: dict[str, str]) -> str:
    return f"translate({inner}, {_literal(''.join(pairs))}, {_literal(''.join(pairs.values()))})"


def _replaced(inner: str, pairs: dict[str, str]) -> str:
    for c, letters in pairs.items():
        inner = f"replace({inner}, {_literal(c)}, {_literal(letters)})"
    return inner


def form_sql(column: str) -> str:
    """The SQL expression of the form of a text column; text of plain ASCII is its own form.

    The replacements one by one are left out where a text has none of their characters. Those after composition need
    only be looked for in the text as stored: a letter they map has a base that is mapped before, unless it was stored
    with an accent already.
    """
    shown = "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in INVISIBLE)
    has = lambda chars: f"regexp_matches({column}, {_literal('[' + ''.join(chars) + ']')})"
    joined, (one, more) = unfolded(), composed_pairs()
    sql = f"regexp_replace({column}, '[{shown}]', '', 'g')"
    sql = f"CASE WHEN {has(joined)} THEN {_replaced(sql, joined)} ELSE {sql} END"
    sql = f"nfc_normalize({_translate(sql, letter_pairs())})"
    sql = f"CASE WHEN {has([*one, *more])} THEN {_translate(_replaced(sql, more), one)} ELSE {sql} END"
    return f"CASE WHEN strlen({column}) = length({column}) THEN {column} ELSE {sql} END"


def _batches(spec: str, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = duckdb.connect(config={"threads": 1})
    for batch in batches:
        con.register("texts", pa.Table.from_batches([batch]))
        yield from con.sql(spec).to_arrow_table().select(names).to_batches()
        con.unregister("texts")


def normalize(df: DataFrame, text: str, output: str = "form") -> DataFrame:
    """Adds the form of ``text`` in column ``output``; a null text has a null form, an empty one an empty form.

    Works row by row, in place: nothing is shuffled, texts of any length are taken whole. All other columns stay,
    whatever their names; one called ``output`` is replaced.
    """
    kept = [c for c in df.columns if c.lower() != output.lower()]
    number = {c: f"c{i}" for i, c in enumerate(df.columns)}
    renamed = df.toDF(*number.values())
    spec = "SELECT " + ", ".join([*(number[c] for c in kept), f"{form_sql(number[text])} AS form"]) + " FROM texts"
    names = [*(number[c] for c in kept), "form"]
    schema = ", ".join(f"{number[c]} {df.schema[c].dataType.simpleString()}" for c in kept) + (", " if kept else "") + "form string"
    out = renamed.mapInArrow(lambda batches: _batches(spec, names, batches), schema)
    return out.toDF(*kept, output)


def _digests(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """(id, form, stored): 128-bit digests of each record's form and text, written once."""
    rows = df.select(F.col(record_id).cast("bigint").alias("id"), F.col(text).alias("text")).dropna()
    spec = f"SELECT id, unhex(md5(f)) AS form, unhex(md5(text)) AS stored FROM (SELECT id, text, {form_sql('text')} AS f FROM texts)"
    return cut(rows.mapInArrow(lambda batches: _batches(spec, ["id", "form", "stored"], batches), "id bigint, form binary, stored binary"), "looks")


def classes(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """(id, class_id, variant_id, variants): each record's class of texts that look the same, one row a record.

    ``class_id`` is the smallest id of the class, ``variant_id`` the smallest with the same stored text, ``variants`` the
    number of different stored texts in the class. All pairs follow from it, and it stays as small as the table where
    one text has very many copies; see :func:`lookalikes` for the method and the cases.
    """
    digests = _digests(df, record_id, text).distinct()
    variants = digests.groupBy("form", "stored").agg(F.min("id").alias("variant_id"))
    whole = variants.groupBy("form").agg(F.min("variant_id").alias("class_id"), F.count(F.lit(1)).alias("variants"))
    named = variants.join(whole, "form").select("form", "stored", "class_id", "variant_id", "variants")
    return digests.join(named, ["form", "stored"]).select("id", "class_id", "variant_id", "variants")


def lookalikes(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """(a, b), a < b: every pair of records whose texts are not equal as stored but look the same.

    Only 128-bit digests of form and text leave the batches, beside the id; they are compared instead of the texts.
    Forms with one stored text drop out after a partial aggregation. The variants of the others are paired, and the
    records join the pairs of variants on the digest of their text; copies of one text are never paired with each
    other, and AQE splits a text that very many records share.

    Rows with a null id or text are left out. Empty texts look like texts of nothing but invisible characters. Ids
    must differ between records; rows repeated whole count once. An empty table gives no rows. Extra columns are not
    read.
    """
    digests = _digests(df, record_id, text)
    several = digests.groupBy("form").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select("form")
    near = digests.join(several, "form", "left_semi").distinct()
    variants = near.select("form", "stored").distinct()
    pairs = variants.alias("x").join(variants.alias("y"), "form").where("x.stored < y.stored").select("form", F.col("x.stored").alias("s"), F.col("y.stored").alias("t"))
    left = pairs.join(near.select(F.col("form"), F.col("stored").alias("s"), F.col("id").alias("i")), ["form", "s"])
    both = left.join(near.select(F.col("form"), F.col("stored").alias("t"), F.col("id").alias("j")), ["form", "t"])
    return both.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))

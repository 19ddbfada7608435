"""Text that looks the same but is made of other characters, brought to one form.

DuckDB runs inside the Arrow partitions (one thread, no files): embedded SQL maps compatibility forms with
``translate``, composes accents with ``nfc_normalize``, removes invisible characters and rewrites look-alike letters
with regular expressions. The tables are made from Unicode data by rule; the look-alike letters are fixed values.

A word (a run of letters) that mixes Latin, Cyrillic and Greek is rewritten in the one script that can hold all of
its letters; a word made only of look-alikes is rewritten if the rest of the text is in another script. A single Latin letter in a
Cyrillic text is rewritten if the next word is Cyrillic (a preposition), and stays otherwise (a type, a size). Emoji sequences
keep their joiners, joiners of scripts that need them stay, and signs with a look of their own (TM, superscripts,
fractions, degree) stay. Letter case and the number of ordinary blanks are no differences of characters.

Null text stays null and is no case; empty text stays empty. No shuffle: rows are mapped where they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters that a reader takes for the Latin letter beside them.
CYRILLIC = "аеорсухіјѕһԁԛԝӏѵАВЕКМНОРСТХУІЈЅԚԜӀѐїЀЇ"
CYRILLIC_AS = "aeopcyxijshdqwlvABEKMHOPCTXYIJSQWIèïÈÏ"
GREEK = "ονυριΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳόύί"
GREEK_AS = "ovupiABEZHIKMNOPTYXcjóúí"
# Latin letters that a reader takes for the letter of the other script beside them.
LATIN_IN_CYRILLIC = "aeopcyxABEKMHOPCTXYk"
AS_CYRILLIC = "аеорсухАВЕКМНОРСТХУк"
LATIN_IN_GREEK = "ovpiuaABEZHIKMNOPTYXkóúíá"
AS_GREEK = "ονριυαΑΒΕΖΗΙΚΜΝΟΡΤΥΧκόύίά"
# Latin letters of phonetic alphabets that look like plain ones, and their plain ones.
PHONETIC, PHONETIC_AS = "ɑɡ", "ag"
INVISIBLE = (
    r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}"
    r"\x{2060}-\x{206F}\x{3164}\x{FEFF}\x{FFA0}"
)
BLANKS = r"\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
EMOJI = r"\x{00A9}\x{00AE}\x{2190}-\x{2BFF}\x{FE0F}\x{1F000}-\x{1FAFF}"
TAGS = r"\x{E0000}-\x{E007F}"  # don't show, but spell the name of a flag behind a black one
FLAG = r"\x{1F3F4}[\x{E0020}-\x{E007E}]+\x{E007F}"
# A joiner that stays is written as a code while the others are removed; the code's own sign is written as another code, so no text is altered.
SIGN = "chr(57344)"
JOINING = r"\p{Arabic}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Myanmar}\p{Mongolian}"
COMPAT_TAGS = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")


@lru_cache(1)
def compat_tables() -> tuple[str, str, list[tuple[str, str]], str]:
    """(from, to) of single characters for translate, multi-character forms, and a class of all of them.

    By rule: letters, digits, marks and punctuation whose decomposition is a width, font or joining form, and
    ligatures of Latin letters. Superscripts, fractions, squared and circled signs have another tag and stay.
    """
    single_from, single_to, multi = [], [], []
    for cp in [*range(0x2000, 0x3400), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1EE00, 0x1EF00), *range(0x1FBF0, 0x1FBFA)]:
        c = chr(cp)
        tag, _, _ = unicodedata.decomposition(c).partition(" ")
        ligature = tag == "<compat>" and 0xFB00 <= cp <= 0xFB17
        if not (tag in COMPAT_TAGS or ligature) or unicodedata.category(c)[0] not in "LNMP":
            continue
        to = unicodedata.normalize("NFKC", c)
        if cp in (0xFF9E, 0xFF9F):
            to = "゙" if cp == 0xFF9E else "゚"
        if len(to) == 1:
            single_from.append(c)
            single_to.append(to)
        else:
            multi.append((c, to))
    ranges = r"\x{2000}-\x{2FFF}\x{3000}-\x{33FF}\x{F900}-\x{FFEF}\x{1D400}-\x{1D7FF}\x{1EE00}-\x{1EEFF}\x{1FBF0}-\x{1FBF9}"
    return "".join(single_from), "".join(single_to), multi, ranges


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@lru_cache(1)
def unify_sql() -> str:
    """The embedded SQL over a view ``batch(src, row_id, keyword)``."""
    one, to, multi, ranges = compat_tables()
    ligatures = "t"
    for c, plain in multi:
        if 0xFB00 <= ord(c) <= 0xFB17:
            ligatures = f"replace({ligatures}, {_q(c)}, {_q(plain)})"
    to_latin = lambda x: f"translate({x}, {_q(CYRILLIC + GREEK)}, {_q(CYRILLIC_AS + GREEK_AS)})"
    # from either foreign script to the wanted one: Greek look-alikes pass through their Latin letter
    to_cyr = lambda x: f"translate(translate({x}, {_q(GREEK)}, {_q(GREEK_AS)}), {_q(LATIN_IN_CYRILLIC)}, {_q(AS_CYRILLIC)})"
    to_greek = lambda x: f"translate(translate({x}, {_q(CYRILLIC)}, {_q(CYRILLIC_AS)}), {_q(LATIN_IN_GREEK)}, {_q(AS_GREEK)})"
    foreign_left = lambda x: f"regexp_matches({to_latin(x)}, '[\\p{{Cyrillic}}\\p{{Greek}}]')"
    word = f"""
        CASE WHEN NOT regexp_matches(w, '\\p{{L}}') THEN w
             WHEN (regexp_matches(w, '\\p{{Latin}}')::INT + regexp_matches(w, '\\p{{Cyrillic}}')::INT + regexp_matches(w, '\\p{{Greek}}')::INT) > 1 THEN
                 CASE WHEN NOT own_cyr AND NOT own_greek AND NOT {foreign_left('w')} THEN {to_latin('w')}
                      WHEN own_cyr AND NOT regexp_matches({to_cyr('w')}, '[\\p{{Latin}}\\p{{Greek}}]') THEN {to_cyr('w')}
                      WHEN own_greek AND NOT regexp_matches({to_greek('w')}, '[\\p{{Latin}}\\p{{Cyrillic}}]') THEN {to_greek('w')}
                      WHEN NOT {foreign_left('w')} THEN {to_latin('w')}
                      ELSE w END
             WHEN regexp_matches(w, '\\p{{Cyrillic}}') AND NOT own_cyr AND other AND NOT {foreign_left('w')} THEN {to_latin('w')}
             WHEN regexp_matches(w, '\\p{{Greek}}') AND NOT own_greek AND other AND NOT {foreign_left('w')} THEN {to_latin('w')}
             WHEN own_cyr AND length(w) = 1 AND regexp_matches(w, '^[aceopyxACEOPYX]$') AND regexp_matches(coalesce(parts[i + 2], ''), '\\p{{Cyrillic}}')
                  THEN {to_cyr('w')}
             ELSE w END"""
    return f"""
    WITH raw AS (SELECT src, row_id, keyword, keyword AS t FROM batch),
    flags AS (
        SELECT * REPLACE (CASE WHEN regexp_matches(t, '[{TAGS}]') THEN array_to_string(list_transform(
            regexp_extract_all(t, '{FLAG}|[^\\x{{1F3F4}}]+|\\x{{1F3F4}}'),
            lambda x: CASE WHEN regexp_full_match(x, '{FLAG}') THEN x ELSE regexp_replace(x, '[{TAGS}]', '', 'g') END), '') ELSE t END AS t) FROM raw),
    held AS (
        SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(replace(t, {SIGN}, {SIGN} || '0'),
            '([{EMOJI}])\\x{{200D}}', '\\1' || {SIGN} || '1', 'g'),
            '([{JOINING}])\\x{{200D}}', '\\1' || {SIGN} || '1', 'g'),
            '([{JOINING}])\\x{{200C}}', '\\1' || {SIGN} || '2', 'g') AS t) FROM flags),
    shown AS (
        SELECT * REPLACE (regexp_replace(regexp_replace(t, '[{INVISIBLE}]', '', 'g'), '[{BLANKS}]', ' ', 'g') AS t) FROM held),
    plain AS (
        SELECT * REPLACE (CASE WHEN regexp_matches(t, '[{ranges}]') THEN translate({ligatures}, {_q(one)}, {_q(to)}) ELSE t END AS t)
        FROM shown),
    composed AS (
        SELECT * REPLACE (translate(nfc_normalize(t), {_q(PHONETIC)}, {_q(PHONETIC_AS)}) AS t) FROM plain),
    scripts AS (
        SELECT *, regexp_matches(translate(t, {_q(CYRILLIC)}, ''), '\\p{{Cyrillic}}') AS own_cyr,
               regexp_matches(translate(t, {_q(GREEK)}, ''), '\\p{{Greek}}') AS own_greek,
               regexp_matches(t, '[\\p{{Latin}}\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}]') AS other,
               regexp_matches(t, '[\\p{{Cyrillic}}\\p{{Greek}}]') AS mixed
        FROM composed),
    cut AS (
        SELECT *, CASE WHEN mixed THEN regexp_extract_all(t, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+') END AS parts FROM scripts),
    worded AS (
        SELECT * REPLACE (CASE WHEN mixed THEN array_to_string(list_transform(parts, lambda w, i: {word}), '') ELSE t END AS t) FROM cut),
    done AS (
        SELECT src, row_id, keyword,
               nfc_normalize(replace(replace(replace(t, {SIGN} || '1', chr(8205)), {SIGN} || '2', chr(8204)), {SIGN} || '0', {SIGN})) AS form
        FROM worded)
    SELECT src, row_id, keyword, form <> keyword AS disguised,
           trim(regexp_replace(form, '\\s+', ' ', 'g')) AS unified
    FROM done"""


def unify(keywords: DataFrame) -> DataFrame:
    """(src, row_id, keyword) -> the same with ``disguised`` (a case) and ``unified`` (the one form).

    Text of plain ASCII goes through the JVM alone; the rest goes to DuckDB inside its Arrow partition.
    """
    sql = unify_sql()

    def run(batches: Iterator) -> Iterator:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1})
        for batch in batches:
            con.register("batch", batch)
            table = con.sql(sql).to_arrow_table()
            con.unregister("batch")
            yield from table.cast(schema).to_batches()

    import pyarrow as pa

    schema = pa.schema(
        [("src", pa.string()), ("row_id", pa.int64()), ("keyword", pa.string()), ("disguised", pa.bool_()), ("unified", pa.string())]
    )
    rows = keywords.select("src", "row_id", "keyword")
    ascii_only = F.col("keyword").isNull() | ~F.col("keyword").rlike(r"[^\x00-\x7F]")
    plain = rows.filter(ascii_only).select(
        "*", F.lit(False).alias("disguised"), F.trim(F.regexp_replace("keyword", r"\s+", " ")).alias("unified")
    )
    other = rows.filter(~ascii_only).mapInArrow(run, "src string, row_id long, keyword string, disguised boolean, unified string")
    return plain.unionByName(other)


def disguised(keywords: DataFrame) -> DataFrame:
    """The cases alone: keywords that hold other characters than the ones a reader sees."""
    return unify(keywords.filter(F.col("keyword").rlike(r"[^\x00-\x7F]"))).filter("disguised")

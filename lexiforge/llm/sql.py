"""DuckDB statements for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from lexiforge.llm.lookalikes import CYRILLIC, GREEK

_BLANK = r"\s\x{00A0}\x{0085}\x{000B}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

_RECORDS = rf"""
    rec AS (
        SELECT 'demo_keywords' AS src, row_id,
               concat_ws(chr(31), coalesce('=' || upload_id, '-'), regexp_replace(lower(upper(regexp_replace(keyword, '[\p{{P}}{_BLANK}]+', '', 'g'))), '[ßẞ]', 'ss', 'g'),
                         coalesce('=' || search_volume, '-'), coalesce('=' || language, '-'), coalesce('=' || country, '-')) AS key
        FROM demo_keywords WHERE keyword IS NOT NULL
        UNION ALL
        SELECT 'duplicate_rows', row_id,
               concat_ws(chr(31), coalesce('=' || upload_id, '-'), regexp_replace(lower(upper(regexp_replace(keyword, '[\p{{P}}{_BLANK}]+', '', 'g'))), '[ßẞ]', 'ss', 'g'),
                         coalesce('=' || volume, '-'),
                         coalesce('=' || array_to_string(list_sort(list_distinct(list_filter(list_transform(
                             string_split(lower(upper(attrs)), ';'), lambda x: regexp_replace(x, '[{_BLANK}]+', '', 'g')),
                             lambda x: x <> ''))), ';'), '-'))
        FROM duplicate_rows WHERE keyword IS NOT NULL)"""



def _p2_found() -> str:
    """A text is a case by its characters, by its accents or by one of its words; nothing is rewritten here."""
    among = lambda c, *spans: "(" + " OR ".join(f"{c} BETWEEN {a} AND {b}" for a, b in spans) + ")"
    emoji = lambda c: among(c, (169, 169), (174, 174), (0x2190, 0x2BFF), (0xFE0F, 0xFE0F), (0x1F000, 0x1FAFF))
    joins = lambda c: among(c, (0x600, 0x6FF), (0x900, 0xDFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1800, 0x18AF))
    hidden = among("c", (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x180B, 0x180E), (0x200B, 0x200B), (0x200E, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFEFF, 0xFEFF))
    blanks = among("c", (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
    forms = among("c", (0xFF01, 0xFFDC), (0xFB00, 0xFB06), (0x1D400, 0x1D7FF), (0x251, 0x251), (0x261, 0x261))
    return rf"""
        WITH kw AS (SELECT 'demo_keywords' AS src, row_id, keyword AS k FROM demo_keywords WHERE keyword IS NOT NULL
            UNION ALL SELECT 'unicode_keywords', row_id, search_keyword FROM unicode_keywords WHERE search_keyword IS NOT NULL),
        odd AS (SELECT *, list_transform(regexp_extract_all(k, '(?s).'), lambda x: unicode(x)) AS cs FROM kw WHERE NOT regexp_full_match(k, '[\x00-\x7F]*')),
        plain AS (SELECT src, row_id, k, nfc_normalize(k) <> k OR len(list_filter(cs, lambda c: {hidden} OR {blanks} OR {forms})) > 0
            OR len(list_filter(range(1, len(cs) + 1), lambda i: cs[i] = 8205 AND NOT coalesce({emoji('cs[i - 1]')} OR {joins('cs[i - 1]')}, false)
                OR cs[i] = 8204 AND NOT coalesce({joins('cs[i - 1]')}, false))) > 0 AS by_sign FROM odd),
        words AS (SELECT *, regexp_extract_all(k, '[\p{{L}}\p{{M}}]+') AS ws,
            len(list_filter(regexp_extract_all(k, '\p{{Cyrillic}}'), lambda c: NOT contains('{CYRILLIC}', c))) > 0 AS cyr,
            len(list_filter(regexp_extract_all(k, '\p{{Greek}}'), lambda c: NOT contains('{GREEK}', c))) > 0 AS gre,
            regexp_matches(k, '[\p{{Latin}}\p{{Han}}\p{{Hiragana}}\p{{Katakana}}]') AS other FROM plain),
        judged AS (SELECT *, len(list_filter(range(1, len(ws) + 1), lambda i:
            regexp_matches(ws[i], '\p{{Latin}}')::INT + regexp_matches(ws[i], '\p{{Cyrillic}}')::INT + regexp_matches(ws[i], '\p{{Greek}}')::INT > 1
            OR (NOT cyr AND other AND regexp_full_match(ws[i], '[{CYRILLIC}]+'))
            OR (NOT gre AND other AND regexp_full_match(ws[i], '[{GREEK}]+'))
            OR (cyr AND regexp_full_match(ws[i], '[aceopyxACEOPYX]') AND regexp_matches(coalesce(ws[i + 1], ''), '\p{{Cyrillic}}')))) > 0 AS by_word FROM words)
        SELECT src, row_id FROM judged WHERE by_sign OR by_word"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _p2_found(),
        "p3_found": f"""WITH {_RECORDS},
            kept AS (SELECT src, row_id, min(row_id) OVER (PARTITION BY src, key) AS keep_id FROM rec)
            SELECT src, keep_id, row_id AS dup_id FROM kept WHERE row_id <> keep_id""",
        "p3_collapsed": f"""WITH {_RECORDS}
            SELECT src, min(row_id) AS row_id, count(*) AS n_copies FROM rec GROUP BY src, key
            UNION ALL SELECT 'demo_keywords', row_id, 1 FROM demo_keywords WHERE keyword IS NULL
            UNION ALL SELECT 'duplicate_rows', row_id, 1 FROM duplicate_rows WHERE keyword IS NULL""",
        "p8_found": r"""
            WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
            dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
            ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM iw),
            dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM dw)
            SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
        "p8_runs": r"""
            WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
            dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
            ig AS (SELECT item_id, unnest(range(1, len(w) - 10)) AS j, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM iw),
            dg AS (SELECT doc_id, unnest(range(1, len(w) - 10)) AS i, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM dw),
            hits AS (SELECT doc_id, item_id, i, i - j AS shift FROM dg JOIN ig USING (g)),
            isles AS (SELECT doc_id, item_id, shift, i - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY i) AS isle FROM hits),
            runs AS (SELECT doc_id, item_id, count(*) + 11 AS n FROM isles GROUP BY doc_id, item_id, shift, isle)
            SELECT doc_id, item_id, max(n) AS longest_run FROM runs GROUP BY doc_id, item_id""",
    }

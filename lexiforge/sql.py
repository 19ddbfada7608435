"""DuckDB statements for the queries of the core that SQL can express."""

from __future__ import annotations

from lexiforge.functions import textnorm as tn
from lexiforge.operators import analytics, drift, match, profile, schema

_LINES = r"""
    lines AS (
        SELECT line_id, string_split(raw_line, '"') AS p FROM raw_lines
        WHERE line_no <> 1 AND regexp_replace(raw_line, '\s+', '', 'g') <> ''),
    marked AS (
        SELECT line_id, len(p) % 2 = 1 AND len(list_filter(range(1, len(p) + 1), lambda i:
                   NOT (i % 2 = 0 OR len(p) = 1
                        OR (i = 1 AND regexp_matches(p[i], '(^|,)\s*$'))
                        OR (i = len(p) AND i > 1 AND regexp_matches(p[i], '^\s*(,|$)'))
                        OR (i > 1 AND i < len(p) AND (p[i] = '' OR
                            (contains(p[i], ',') AND regexp_matches(p[i], '^\s*,') AND regexp_matches(p[i], ',\s*$'))))))) = 0 AS ok,
               list_transform(string_split(array_to_string(list_transform(range(1, len(p) + 1), lambda i:
                   CASE WHEN i % 2 = 0 THEN replace(p[i], ',', chr(1)) WHEN p[i] = '' AND i > 1 AND i < len(p) THEN '"' ELSE p[i] END), ''), ','),
                   lambda c: regexp_replace(replace(c, chr(1), ','), '^\s+|\s+$', '', 'g')) AS c
        FROM lines),
    judged AS (
        SELECT line_id, c, CASE
            WHEN NOT ok THEN 'quoting' WHEN len(c) <> 5 THEN 'column_count'
            WHEN c[1] = '' OR NOT regexp_full_match(c[2], '[0-9]*') OR NOT regexp_full_match(c[3], '([0-9]+(\.[0-9]+)?)?')
                 OR NOT regexp_full_match(c[4], '([A-Z]{2})?') OR NOT regexp_full_match(c[5], '([0-9]{4}-[0-9]{2}-[0-9]{2})?')
                 OR (c[5] <> '' AND (try_cast(c[5] AS DATE) IS NULL OR c[5][1:4] = '0000')) THEN 'invalid_value' END AS reason
        FROM marked)"""

_SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fold(x: str) -> str:
    """Compatibility folding to ASCII with a map of the characters whose decomposition holds ASCII."""
    each = f"array_to_string(list_transform(string_split({x}, ''), lambda ch: coalesce(fold_map[ch], ch)), '')"
    return f"CASE WHEN regexp_matches({x}, '[^\\x00-\\x7F]') THEN regexp_replace({each}, '[^\\x00-\\x7F]', '', 'g') ELSE {x} END"


def _fold_map() -> str:
    table = tn.ascii_fold_table()
    return f"MAP {{{', '.join(f'{_q(k)}: {_q(v)}' for k, v in table.items())}}}"


def _lower(x: str) -> str:
    return f"lower({x})"


def _squeeze(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[{_SPACE}]+', ' ', 'g'), '^ | $', '', 'g')"


def _open(x: str) -> str:
    return f"translate({x}, '-/_.', '    ')"


def _words(mapping: dict[str, str]):
    def sql(x: str) -> str:
        for k, v in sorted(mapping.items(), key=lambda kv: len(kv[0]), reverse=True):
            x = f"regexp_replace({x}, '(?i)\\b{k}\\b', {_q(v)}, 'g')"
        return x

    return sql


def _units(x: str) -> str:
    return f"regexp_replace({x}, '(?i)(\\d+)\\s+({'|'.join(tn.UNITS)})\\b', '\\1\\2', 'g')"


def _lemmas(x: str) -> str:
    irregular = " ".join(f"WHEN lower(t) = '{k}' THEN '{v}'" for k, v in tn.IRREGULAR.items())
    one = (
        f"CASE {irregular} WHEN lower(t) LIKE '%ies' AND length(t) > 4 THEN lower(t)[:-4] || 'y'"
        " WHEN lower(t) LIKE '%ing' AND length(t) > 4 THEN lower(t)[:-4]"
        " WHEN lower(t) LIKE '%s' AND lower(t) NOT LIKE '%ss' AND length(t) > 3 THEN lower(t)[:-2] ELSE t END"
    )
    return f"array_to_string(list_transform(list_filter(regexp_split_to_array({x}, '[{_SPACE}]+'), lambda t: t <> ''), lambda t: {one}), ' ')"


def _zeros(x: str) -> str:
    return f"regexp_replace({x}, '\\b0+(\\d)', '\\1', 'g')"


def _stop(x: str) -> str:
    return _squeeze(f"regexp_replace({x}, '(?i)\\b(?:{'|'.join(tn.STOP_WORDS)})\\b', '', 'g')")


def _sort(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(regexp_split_to_array({x}, '[{_SPACE}]+'), lambda t: t <> '')), ' ')"


_MAPPED = f"WITH m AS (SELECT {_fold_map()} AS fold_map), kw AS (SELECT *, coalesce(keyword, '') AS k FROM demo_keywords, m)"


def _rule(expr) -> str:
    return f"{_MAPPED} SELECT row_id, {expr('k')} AS text FROM kw"


def _after(expr) -> str:
    return (
        f"{_MAPPED}, a AS (SELECT row_id, fold_map, {_squeeze(_lower('k'))} AS s FROM kw), p AS (SELECT row_id, {_fold('s')} AS f FROM a)"
        f" SELECT row_id, {expr('f')} AS text FROM p"
    )


def _engine() -> str:
    names = ["case", "whitespace", "unicode", "punctuation", "dictionary", "units", "numeric"]
    rules = [_lower, _squeeze, _fold, _open, _words(tn.DICTIONARY), _units, _zeros]
    ctes, last = [], "(SELECT row_id, fold_map, k AS s0 FROM kw)"
    for i, r in enumerate(rules):
        ctes.append(f"t{i} AS (SELECT *, {r(f's{i}')} AS s{i + 1} FROM {last})")
        last = f"t{i}"
    trace = ", ".join(f"CASE WHEN s{i + 1} <> s{i} THEN '{n}' END" for i, n in enumerate(names))
    return f"{_MAPPED}, {', '.join(ctes)}, traced AS (SELECT row_id, s{len(rules)} AS normalized_keyword, concat_ws(' -> ', {trace}) AS normalization_trace FROM {last})"


def _md5_mod(k: str, m: int) -> str:
    r = "0"
    for i in range(4):
        r = f"((({r}) * {(1 << 32) % m} + ('0x' || substr(md5({k}), {1 + 8 * i}, 8))::BIGINT) % {m})"
    return r


_LCS = """(length(b) - bit_count(list_reduce(list_prepend((1::BIGINT << length(b)) - 1, list_transform(string_split(a, ''), lambda ch:
    list_sum(list_transform(range(1, length(b) + 1), lambda j: CASE WHEN substr(b, j, 1) = ch THEN 1::BIGINT << (j - 1) ELSE 0 END))::BIGINT)),
    lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length(b)) - 1))))"""

_PART = """pk AS (SELECT p_partkey AS row_id, CASE p_partkey % 10 WHEN 1 THEN upper(p_name) || '  ' WHEN 2 THEN p_name || 'x'
    WHEN 3 THEN p_name || p_partkey ELSE p_name END AS keyword FROM part)"""

_KEY = r"trim(regexp_replace(lower(keyword), '[\s\x0B\x{A0}]+', ' ', 'g'))"


def _normalised(src: str) -> str:
    return f"""ns AS (SELECT keyword, count(*) AS n, min(row_id) AS f, {_KEY} AS key FROM {src} WHERE keyword IS NOT NULL GROUP BY keyword),
        nc AS (SELECT key, arg_min(keyword, f) AS src FROM ns GROUP BY key HAVING count(*) > 1),
        ne AS (SELECT src, keyword AS dst, n FROM ns JOIN nc USING (key) WHERE keyword <> src)"""


def _fuzzy(src: str) -> str:
    return f"""fs AS (SELECT DISTINCT keyword FROM {src} WHERE keyword <> ''),
        fp AS (SELECT x.keyword AS a, y.keyword AS b FROM fs x JOIN fs y ON lower(x.keyword[1]) = lower(y.keyword[1]) AND x.keyword < y.keyword
               AND 200.0 * least(length(x.keyword), length(y.keyword)) >= 90.0 * (length(x.keyword) + length(y.keyword))),
        fe AS (SELECT a AS src, b AS dst, 200.0 * {_LCS} / (length(a) + length(b)) AS confidence FROM fp
               WHERE levenshtein(a, b) <= floor((length(a) + length(b)) * {1 - 90.0 / 100.0} + 1e-9))"""


_DETECT = f"""WITH RECURSIVE {_PART}, {_normalised('pk')},
    rest AS (SELECT keyword FROM pk WHERE keyword NOT IN (SELECT dst FROM ne)), {_fuzzy('rest')},
    e AS (SELECT src, dst FROM ne UNION SELECT src, dst FROM fe WHERE confidence >= 90),
    b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    reach AS (SELECT src AS node, src AS label FROM b UNION SELECT b.dst, reach.label FROM reach JOIN b ON reach.node = b.src),
    comp AS (SELECT node, min(label) AS label FROM reach GROUP BY node),
    g AS (SELECT node AS member, first_value(node) OVER (PARTITION BY label ORDER BY length(node), node) AS canonical FROM comp),
    marked AS (SELECT row_id, pk.keyword, CASE WHEN row_id <> min(row_id) OVER (PARTITION BY pk.keyword) OR coalesce(g.canonical <> pk.keyword, false)
               THEN 'DUPLICATE' ELSE 'ACTIVE' END AS status FROM pk LEFT JOIN g ON g.member = pk.keyword)"""


def _plain(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), '\\p{{L}}+|\\P{{L}}+'), lambda w: upper(w[1]) || w[2:]), '')"


_NAV = rf"""nav AS (SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS ord FROM (SELECT page_id, regexp_extract_all(array_to_string(
        regexp_extract_all(html, '(?is)<(?:nav|div role="navigation")[^>]*>(.*?)</(?:nav|div)>', 1), ' '), '(?is)<li[^>]*>\s*<a\b[^>]*>(.*?)</a>', 1) AS l FROM collected_content)),
    navs AS (SELECT page_id, ord, {_plain('t')} AS entity FROM nav)"""


def _heads(level: int, most: int) -> str:
    parent = f"nullif({_plain(chr(39).join(['regexp_extract(html, ', '(?is)<h1\\b[^>]*>(.*?)</h1>', ', 1)']))}, '')" if level > 1 else "NULL::VARCHAR"
    return f"""(SELECT page_id, 'H{level}' AS level, ord, {_plain('t')} AS entity, parent FROM (SELECT page_id, {parent} AS parent, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS ord
        FROM (SELECT page_id, html, regexp_extract_all(html, '(?is)<h{level}\\b[^>]*>(.*?)</h{level}>', 1) AS l FROM collected_content))
        WHERE length({_plain('t')}) > 3 AND length({_plain('t')}) < {most})"""


_HEADS = f"heads AS (SELECT * FROM {_heads(1, 50)} UNION ALL SELECT * FROM {_heads(2, 30)})"
_SEGS = rf"""segs AS (SELECT page_id, ord, entity, CASE WHEN ord = len(a) - 1 THEN 'Product' ELSE 'Category' END AS entity_type,
        CASE WHEN ord > 0 AND length(a[ord]) >= 3 THEN a[ord] END AS parent FROM (SELECT page_id, a, unnest(a) AS entity, generate_subscripts(a, 1) - 1 AS ord
        FROM (SELECT page_id, list_transform(list_filter(string_split(url_decode(regexp_extract(source_url, '^[a-z]+://[^/]+/([^?#]*)', 1)), '/'), lambda p: p <> ''),
            lambda p: {_title("translate(p, '-_', '  ')")}) AS a FROM collected_content)) WHERE length(entity) >= 3)"""
_SAME = "CASE lower(x) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in profile.SAME_ENTITY.items()) + " ELSE x END"
_LD = r"""ld AS (SELECT page_id, unnest(CASE WHEN json_type(x) = 'ARRAY' THEN from_json(x, '["JSON"]') ELSE [x] END) AS j FROM (SELECT page_id, try_cast(trim(t) AS JSON) AS x
        FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1)) AS t FROM collected_content)) WHERE x IS NOT NULL)"""
_MENTIONS = f"""{_NAV}, {_HEADS}, {_SEGS}, {_LD},
    ment AS (SELECT page_id, 'NAVIGATION' AS source, 0 AS rank, ord, entity, 'Category' AS entity_type, NULL::VARCHAR AS parent FROM navs WHERE length(entity) > 2
        UNION ALL SELECT page_id, level, 1, ord, entity, 'Product', parent FROM heads
        UNION ALL SELECT page_id, 'URL', 2, ord, entity, entity_type, parent FROM segs
        UNION ALL SELECT page_id, 'SCHEMA', 3, 0, j->>'$.name', 'Product', j->>'$.brand.name' FROM ld WHERE j->>'$."@type"' = 'Product' AND j->>'$.name' <> ''
        UNION ALL SELECT page_id, 'SCHEMA', 3, 1, j->>'$.brand.name', 'Brand', NULL FROM ld WHERE j->>'$."@type"' = 'Product' AND j->>'$.brand.name' <> ''),
    canon AS (SELECT * REPLACE ({_SAME.replace('x', 'entity')} AS entity, {_SAME.replace('x', 'parent')} AS parent) FROM
        (SELECT * REPLACE (trim(regexp_replace(entity, '\\s+', ' ', 'g')) AS entity, trim(regexp_replace(parent, '\\s+', ' ', 'g')) AS parent) FROM ment)),
    evid AS (SELECT entity, arg_min(entity_type, (page_id, rank, source, ord)) AS entity_type,
        array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(DISTINCT source)::DOUBLE AS confidence FROM canon WHERE entity <> '' GROUP BY entity)"""
_ENT = "ent AS (SELECT base AS entity, min(alias_id) AS ord FROM fact_aliases WHERE base IS NOT NULL GROUP BY base)"
_NO = ", ".join(_q(w) for w in profile.NO_ENTITY)

_RUNS = r"""wk AS (SELECT row_id, string_split(trim(regexp_replace(lower(keyword), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM demo_keywords WHERE keyword IS NOT NULL),
    runs AS (SELECT DISTINCT row_id, unnest(flatten(list_transform(range(1, 7), lambda n: list_transform(range(1, greatest(len(w) - n + 1, 1) + 1),
        lambda i: array_to_string(w[i:i + n - 1], ' '))))) AS run FROM wk),
    pats AS (SELECT kind, term_id AS ord, term_name AS entity, trim(regexp_replace(lower(term_name), '[^\p{L}\p{N}]+', ' ', 'g')) AS run FROM canon_terms),
    found AS (SELECT DISTINCT row_id, kind, ord, entity FROM runs JOIN pats USING (run) WHERE run <> '')"""
_INTENTS = analytics.INTENTS


def _words_of(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


_TECHNOLOGIES = ("144hz", "16gb", "usb c", "dual band", "bluetooth")
_RESOLVED = f"""
    ev AS (SELECT base, count(*)::DOUBLE AS evidence FROM fact_aliases WHERE base IS NOT NULL GROUP BY base),
    ent AS (
        SELECT kind, term_id AS ord, term_name AS entity, NULL AS parent, coalesce(evidence, 0) AS evidence FROM canon_terms LEFT JOIN ev ON base = term_name
        UNION ALL SELECT 'synonym', term_id, unnest(short_forms), term_name, 0 FROM canon_terms
        UNION ALL SELECT 'family', min(term_id), string_split(term_name, ' ')[-1], arg_min(term_name, term_id), 0 FROM canon_terms WHERE kind = 'category' GROUP BY string_split(term_name, ' ')[-1]
        UNION ALL SELECT 'product', min(alias_id), alias, arg_min(base, alias_id), 0 FROM fact_aliases WHERE length(alias) > 3 AND base IS NOT NULL GROUP BY alias
        UNION ALL SELECT 'technology', ord, entity, NULL, 0 FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(_TECHNOLOGIES, 1))}) x(ord, entity)),
    kwt AS (SELECT row_id, ' ' || {_words_of('keyword')} || ' ' AS t FROM demo_keywords WHERE keyword IS NOT NULL),
    hits AS (SELECT row_id, kind, ord, entity, parent, evidence FROM kwt, (SELECT *, {_words_of('entity')} AS run FROM ent) WHERE run <> '' AND contains(t, ' ' || run || ' ')),
    firsts AS (SELECT row_id, kind, arg_min(struct_pack(entity, parent, evidence), (ord, entity)) AS f FROM hits GROUP BY row_id, kind),
    resolved AS (SELECT row_id, kind, f.entity AS entity, CASE WHEN kind IN ('family', 'product') THEN coalesce(f.parent, 'Unknown') ELSE f.parent END AS parent,
        CASE kind WHEN 'brand' THEN 0.98 WHEN 'category' THEN CASE WHEN f.evidence > 1 THEN 0.92 ELSE 0.85 END ELSE 1.0 END::DOUBLE AS score FROM firsts)"""


def _union() -> str:
    """The fields of all JSON records with their kinds; the table of names is the operator's parameter."""
    pairs = ", ".join(f"('{n}', '{q}')" for q, ns in drift.KNOWN_NAMES.items() for n in sorted({*ns, q.replace("_", " ")}))
    return rf"""
        WITH named(name, q) AS (VALUES {pairs}),
        f AS (SELECT unnest(json_keys(payload)) AS field, payload FROM feed_rows WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
        v AS (SELECT field, json_extract(payload, '$."' || field || '"') AS val FROM f),
        k AS (SELECT field, CASE json_type(val) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object'
                WHEN 'DOUBLE' THEN 'decimal' WHEN 'NULL' THEN NULL ELSE 'whole' END AS kind FROM v),
        n AS (SELECT *, trim(regexp_replace(lower(regexp_replace(field, '([a-z])([A-Z])', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS name FROM k WHERE kind IS NOT NULL)
        SELECT coalesce(q, '?' || name) AS quantity, field, kind, count(*) AS n FROM n LEFT JOIN named USING (name) GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    head = f"WITH {_LINES}"
    found = {
        "p7_found": f"{head} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
        "p7_clean": f"""{head} SELECT line_id, c[1] AS keyword, try_cast(nullif(c[2], '') AS DECIMAL(38,0)) AS volume,
            try_cast(nullif(c[3], '') AS DOUBLE) AS cpc, nullif(c[4], '') AS country, try_cast(nullif(c[5], '') AS DATE) AS seen_on,
            CASE WHEN try_cast(nullif(c[2], '') AS DECIMAL(38,0)) IS NULL THEN nullif(c[2], '') END AS volume_text
            FROM judged WHERE reason IS NULL""",
        "p5_union": _union(),
        "norm_case_whitespace": _rule(lambda x: _squeeze(_lower(x))),
        "norm_unicode_fold": _rule(_fold),
        "norm_punctuation": _rule(_open),
        "norm_dictionary": _after(_words(tn.DICTIONARY)),
        "norm_company_dictionary": _after(_words({"cindibrax studio": "cindibrax", "obrottan": "obro"})),
        "norm_units": _after(_units),
        "norm_lemmas": _after(_lemmas),
        "norm_numeric": _after(_zeros),
        "norm_stop_words": _after(_stop),
        "norm_token_sort": _after(_sort),
        "norm_engine": f"{_engine()} SELECT * FROM traced",
        "norm_metrics": f"""{_engine()} SELECT 'total_processed' AS metric, count(*) AS n FROM traced
            UNION ALL SELECT 'total_modified', count(*) FROM traced WHERE normalization_trace <> ''
            UNION ALL SELECT metric, count(*) FROM (SELECT unnest(string_split(normalization_trace, ' -> ')) AS metric FROM traced) WHERE metric <> '' GROUP BY metric""",
        "string_functions": rf"""{_MAPPED}, a AS (SELECT *, {_fold('k')} AS f FROM kw), w AS (SELECT *, list_filter(string_split({_squeeze('f')}, ' '), lambda t: t <> '') AS ws FROM a)
            SELECT row_id, sha256(concat_ws('|', company_id::VARCHAR, keyword, 'mock', '1.0.0')) AS cache_key,
            CASE WHEN length(keyword) <= 12 THEN keyword ELSE substr(keyword, 1, 9) || '...' END AS short,
            regexp_matches(keyword, '^\d+\.\d+\.\d+$') AS semver,
            CASE WHEN len(ws) > 1 THEN array_to_string(list_transform(list_filter(ws, lambda t: regexp_full_match(t, '\p{{L}}+')), lambda t: upper(t[1])), '') END AS acronym FROM w""",
        "profile_keys": rf"""SELECT company_id, concat_ws(':', lower(trim(company_name)), lower(trim(website))) AS profile_key,
            {_title("regexp_extract(regexp_replace(regexp_extract(website, '^[a-z]+://([^/]+)', 1), '^www[.]', ''), '^([^.]+)', 1)")} AS domain_brand FROM companies""",
        "schema_projection": "SELECT keyword, search_volume AS volume, cpc, country FROM demo_keywords",
        "column_resolution": f"""WITH f AS (SELECT DISTINCT trim(lower(unnest(json_keys(payload)))) AS a FROM feed_rows),
            al AS (SELECT unnest([{', '.join(_q(a) for a in schema.KEYWORD_ALIASES)}]) AS b),
            best AS (SELECT a AS field, max(200.0 * {_LCS} / (length(a) + length(b))) AS s FROM f, al GROUP BY a)
            SELECT field, CASE WHEN field = 'keyword' THEN 'EXACT' WHEN field IN (SELECT b FROM al) THEN 'ALIAS' WHEN s >= 90 THEN 'FUZZY' ELSE 'NONE' END AS method,
            CASE WHEN field = 'keyword' THEN 100.0 WHEN field IN (SELECT b FROM al) THEN 95.0 ELSE round(s, 2) END::DOUBLE AS score FROM best""",
        "drop_empty_and_repeats": "SELECT min(row_id) AS row_id, keyword FROM demo_keywords WHERE keyword <> '' GROUP BY keyword",
        "dedup_exact": "SELECT keyword AS src, keyword AS dst, 'exact' AS strategy, 100.0::DOUBLE AS confidence, count(*) - 1 AS n FROM demo_keywords WHERE keyword IS NOT NULL GROUP BY keyword HAVING count(*) > 1",
        "dedup_normalized": f"WITH {_normalised('demo_keywords')} SELECT src, dst, 'normalized' AS strategy, 95.0::DOUBLE AS confidence, n FROM ne",
        "dedup_fuzzy_edges": f"WITH {_PART}, {_fuzzy('pk')} SELECT src, dst, round(confidence, 4)::DOUBLE AS confidence FROM fe WHERE confidence >= 90",
        "dedup_groups": f"{_DETECT} SELECT canonical, member FROM g",
        "dedup_status": f"{_DETECT} SELECT row_id, keyword, status FROM marked",
        "dedup_stats": f"""{_DETECT} SELECT 'candidates_exact' AS metric, sum(c - 1)::BIGINT AS n FROM (SELECT count(*) AS c FROM pk GROUP BY keyword) WHERE c > 1
            UNION ALL SELECT 'candidates_normalized', sum(n)::BIGINT FROM ne UNION ALL SELECT 'candidates_fuzzy', count(*) FROM fe WHERE confidence >= 90
            UNION ALL SELECT 'rows_' || lower(status), count(*) FROM marked GROUP BY status""",
        "keyword_components": f"""WITH {_normalised('demo_keywords')}, m AS (SELECT src, src AS node FROM ne UNION SELECT src, dst FROM ne)
            SELECT node, min(node) OVER (PARTITION BY src) AS label FROM m""",
        "blocking_prefix": "SELECT lower(keyword[1]) AS block, count(*) AS n FROM demo_keywords WHERE keyword <> '' GROUP BY 1",
        "blocking_length": "SELECT length(keyword)::INTEGER AS block, count(*) AS n FROM demo_keywords WHERE keyword <> '' GROUP BY 1",
        "extract_navigation": f"WITH {_NAV} SELECT page_id, entity, count(*) AS n FROM navs WHERE length(entity) > 2 GROUP BY ALL",
        "extract_headings": f"WITH {_HEADS} SELECT page_id, level, ord::INTEGER AS ord, entity, parent FROM heads",
        "extract_url_segments": f"WITH {_SEGS} SELECT page_id, ord::INTEGER AS ord, entity, entity_type, parent FROM segs",
        "extract_links": r"""WITH l AS (SELECT page_id, regexp_extract(source_url, '^(https?://[^/]+)', 1) AS h, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"#]*)', 1)) AS l FROM collected_content),
            a AS (SELECT page_id, h, CASE WHEN regexp_matches(l, '^https?://') THEN l WHEN l LIKE '/%' THEN h || l END AS link FROM l WHERE l <> '')
            SELECT DISTINCT page_id, regexp_replace(link, '/+$', '') AS link FROM a WHERE starts_with(link, h)""",
        "page_text": rf"""WITH t AS (SELECT page_id, {_plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
            {_plain("regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script" + chr(92) + "b.*?</script" + chr(92) + "s*>|<style" + chr(92) + "b.*?</style" + chr(92) + "s*>|<noscript" + chr(92) + "b.*?</noscript" + chr(92) + "s*>|<svg" + chr(92) + "b.*?</svg" + chr(92) + "s*>|<button" + chr(92) + "b.*?</button" + chr(92) + "s*>|<footer" + chr(92) + "b.*?</footer" + chr(92) + "s*>', ' ', 'g'), '<[^>]*>', ' ', 'g')")} AS body FROM collected_content)
            SELECT page_id, title, length(body)::INTEGER AS n_chars FROM t""",
        "url_filter": f"SELECT page_id FROM collected_content WHERE NOT regexp_matches(source_url, '(?i){'|'.join(profile.IGNORED_PATHS)}')",
        "crawl_budget": f"""SELECT company_id, page_id FROM (SELECT company_id, page_id, row_number() OVER (PARTITION BY company_id ORDER BY collected_at, page_id) AS k
            FROM collected_content WHERE NOT regexp_matches(source_url, '(?i){'|'.join(profile.IGNORED_PATHS)}')) WHERE k <= {profile.MAX_PAGES}""",
        "entity_evidence": f"WITH {_MENTIONS} SELECT * FROM evid",
        "taxonomy_edges": f"WITH {_MENTIONS} SELECT DISTINCT entity AS child, parent FROM canon WHERE entity <> '' AND parent <> '' AND entity <> parent",
        "entity_split": rf"""WITH {_ENT}, s AS (SELECT ord, unnest(l) AS p, generate_subscripts(l, 1) AS k FROM (SELECT ord, regexp_split_to_array(entity, '(?i),|\b&\b|\band\b') AS l FROM ent)),
            t AS (SELECT ord, k, trim(regexp_replace(p, '\s+', ' ', 'g')) AS entity FROM s)
            SELECT arg_min(entity, (ord, k)) AS entity FROM t WHERE length(entity) >= 2 AND len(string_split(entity, ' ')) <= 3 AND lower(entity) NOT IN ({_NO})
            AND NOT regexp_full_match(entity, '[\d\W]+') GROUP BY lower(entity)""",
        "family_mining": rf"""WITH {_ENT}, w AS (SELECT entity, regexp_split_to_array(entity, ' +') AS w FROM ent),
            f AS (SELECT entity, unnest([CASE WHEN length(w[1]) > 2 AND regexp_matches(w[1], '^\p{{Lu}}') AND lower(w[1]) NOT IN ({_NO}) AND lower(w[1]) <> 'snorandoq' THEN w[1] END,
                CASE WHEN len(w) > 1 AND length(w[1] || ' ' || w[2]) > 5 AND regexp_matches(w[1], '^\p{{Lu}}') AND regexp_matches(w[2], '^\p{{Lu}}')
                AND (lower(w[1]) NOT IN ({_NO}) OR lower(w[1]) = 'snorandoq') AND lower(w[2]) NOT IN ({_NO}) AND lower(w[1] || ' ' || w[2]) NOT IN ({_NO}) THEN w[1] || ' ' || w[2] END]) AS family FROM w)
            SELECT family, count(*) AS n FROM f WHERE family IS NOT NULL GROUP BY family HAVING count(*) >= 2 AND count(DISTINCT entity) >= 2""",
        "alias_mining": rf"""WITH {_ENT}, a AS (SELECT ord, trim(regexp_extract(entity, '^(.*?)\s*\(([^)]+)\)$', 1)) AS base, trim(regexp_extract(entity, '^(.*?)\s*\(([^)]+)\)$', 2)) AS alias FROM ent)
            SELECT alias, arg_max(base, (ord, base)) AS base FROM a WHERE base <> '' AND length(alias) >= 2 AND NOT regexp_full_match(alias, '\d+') AND NOT regexp_full_match(alias, '(19|20)\d{{2}}')
            AND NOT regexp_full_match(alias, '(?i)\d+\s*(m|cm|mm|inch|gb|tb|hz|khz|mhz|w|kw|v)') AND lower(alias) NOT IN ({', '.join(_q(a) for a in profile.NO_ALIAS)}) GROUP BY alias""",
        "synonym_mining": rf"""WITH {_ENT}, s AS (SELECT trim(regexp_extract(entity, '^(.*?)\s*/\s*(.*?)$', 1)) AS a, trim(regexp_extract(entity, '^(.*?)\s*/\s*(.*?)$', 2)) AS b FROM ent),
            g AS (SELECT a, b FROM s WHERE length(a) > 2 AND length(b) > 2 AND ((lower(a), lower(b)) IN ({', '.join(f"('{k}', '{v}')" for k, v in profile.INDUSTRY_SYNONYMS.items())})
                OR ends_with(lower(a), lower(b)) OR ends_with(lower(b), lower(a))))
            SELECT lower(a) AS term, b AS synonym FROM g UNION SELECT lower(b), a FROM g""",
        "brand_canonical": _brand(),
        "fact_warnings": rf"""WITH {_MENTIONS}, fa AS (SELECT base FROM fact_aliases WHERE base IS NOT NULL)
            SELECT 'count' AS rule, w || ' ' || n AS detail FROM (SELECT unnest(['brands', 'products', 'categories']) AS w, unnest([count(*) FILTER (entity_type = 'Brand'),
                count(*) FILTER (entity_type = 'Product'), count(*) FILTER (entity_type = 'Category')]) AS n, unnest([1, 10, 5]) AS least FROM evid) WHERE n < least
            UNION SELECT 'unique', lower(entity) FROM evid GROUP BY entity_type, lower(entity) HAVING count(*) > 1
            UNION SELECT 'malformed', entity FROM evid WHERE regexp_full_match(entity, '[0-9\W]+')
            UNION SELECT 'alias_target', base FROM fa WHERE lower(base) NOT IN (SELECT lower(entity) FROM evid)""",
        "profile_quality": f"""WITH {_MENTIONS}, n AS (SELECT count(*) FILTER (entity_type = 'Product') AS p, count(*) FILTER (entity_type = 'Category') AS c, count(*) FILTER (entity_type = 'Brand') AS b FROM evid)
            SELECT round(least((SELECT count(*) FROM collected_content) / 5, 1.0) * 20 + least(p / 5, 1.0) * 30 + least(c / 5, 1.0) * 20 + least(b / 2, 1.0) * 20, 1)::DOUBLE AS quality FROM n""",
        "match_all": f"WITH {_RUNS} SELECT row_id, kind, string_agg(entity, '|' ORDER BY ord, entity) AS entities, count(*) AS n FROM found GROUP BY row_id, kind",
        "match_first": f"WITH {_RUNS} SELECT row_id, kind, arg_min(entity, (ord, entity)) AS entity FROM found GROUP BY row_id, kind",
        "match_profile": f"""WITH {_RUNS}, f AS (SELECT row_id, kind, arg_min(entity, (ord, entity)) AS entity, count(*) AS n FROM found GROUP BY row_id, kind),
            w AS (SELECT row_id, max(entity) FILTER (kind = 'brand') AS brand, max(entity) FILTER (kind = 'category') AS category, coalesce(max(n) FILTER (kind = 'brand'), 0) AS n_brands FROM f GROUP BY row_id)
            SELECT *, CASE WHEN n_brands > 1 THEN 'Comparison query' ELSE 'Matched ' || concat_ws(' and ', 'brand ''' || brand || '''', 'category ''' || category || '''') END AS reason FROM w""",
        "match_counts": f"""WITH {_RUNS} SELECT kind, count(DISTINCT row_id) AS matches, (SELECT count(*) FROM demo_keywords) - count(DISTINCT row_id) AS misses
            FROM (VALUES ('brand'), ('category')) k(kind) LEFT JOIN found USING (kind) GROUP BY kind""",
        "resolver_scores": f"WITH {_RESOLVED} SELECT row_id, kind, entity, parent, score FROM resolved",
        "rule_engine": f"""WITH {_RESOLVED},
            w AS (SELECT row_id, {", ".join(f"max(entity) FILTER (kind = '{k}') AS {k}" for k in match.KINDS)},
                max(parent) FILTER (kind = 'product') AS pc, max(parent) FILTER (kind = 'family') AS fc, max(score) AS score FROM resolved GROUP BY row_id),
            b AS (SELECT row_id, count(DISTINCT entity) AS nb, max(entity) FILTER (lower(entity) = 'snorandoq') AS own FROM hits WHERE kind = 'brand' GROUP BY row_id)
            SELECT d.row_id, coalesce(own, brand, CASE WHEN product IS NOT NULL OR family IS NOT NULL THEN 'Snorandoq' END) AS brand, coalesce(category, pc, fc) AS category,
            family, product, technology, synonym, coalesce(nb, 0) AS n_brands, CASE WHEN coalesce(nb, 0) > 1 OR score IS NULL THEN 0.0 ELSE score END::DOUBLE AS confidence,
            coalesce(nb, 0) > 1 OR score IS NULL AS needs_review,
            CASE WHEN score IS NULL THEN 'No match' WHEN coalesce(nb, 0) > 1 THEN 'Comparison query'
                ELSE 'Matched ' || concat_ws(' and ', {", ".join(f"'{k} ' || chr(39) || {k} || chr(39)" for k in match.KINDS)}) END AS reason
            FROM demo_keywords d LEFT JOIN w ON d.row_id = w.row_id LEFT JOIN b ON d.row_id = b.row_id""",
        "match_cascade": f"""WITH {_RESOLVED},
            lv(kind, level, base, growth, most) AS (VALUES {", ".join(f"('{k}', {i}, {b}, {g}, {m})" for i, (k, b, g, m) in enumerate(match.LEVELS, 1))}),
            seg AS (SELECT e AS entity, min(company_id) AS ord FROM (SELECT company_id, unnest(customer_segments) AS e FROM companies) GROUP BY e),
            own AS (SELECT string_split(company_name, ' ')[1] AS entity, company_id AS ord FROM companies WHERE company_id = 17),
            all_hits AS (
                SELECT row_id, CASE kind WHEN 'synonym' THEN 'alias' ELSE kind END AS kind, ord, entity, evidence FROM hits
                UNION ALL SELECT row_id, 'segment', ord, entity, 0 FROM kwt, seg WHERE contains(t, ' ' || {_words_of('entity')} || ' ')
                UNION ALL SELECT row_id, 'company', ord, entity, 0 FROM demo_keywords, own WHERE contains(lower(keyword), lower(entity))),
            best AS (SELECT row_id, arg_min(struct_pack(level, kind, entity, c := least(most::DOUBLE, base + growth * evidence)), (level, ord, entity)) AS f FROM all_hits JOIN lv USING (kind) GROUP BY row_id)
            SELECT d.row_id, f.level, f.kind, f.entity, CASE WHEN f IS NULL THEN 'UNCERTAIN' ELSE 'RELEVANT' END AS relevance, coalesce(f.c, 0.0)::DOUBLE AS confidence
            FROM demo_keywords d LEFT JOIN best USING (row_id)""",
        "lookup_volume": f"""SELECT keyword, 10 + {_md5_mod('keyword', 499_990)} AS search_volume,
            CASE WHEN {_md5_mod('keyword', 100)} < 30 THEN 'LOW' WHEN {_md5_mod('keyword', 100)} < 70 THEN 'MEDIUM' ELSE 'HIGH' END AS competition,
            round(0.05 + {_md5_mod('keyword', 4995)} / 100, 2)::DOUBLE AS cpc FROM (SELECT DISTINCT keyword FROM demo_keywords WHERE keyword IS NOT NULL)""",
        "lookup_classes": f"""SELECT keyword, ['RELEVANT', 'IRRELEVANT', 'UNCERTAIN'][{_md5_mod('keyword', 3)} + 1] AS relevance,
            round(0.5 + {_md5_mod('keyword', 51)} / 100, 2)::DOUBLE AS confidence FROM (SELECT DISTINCT keyword FROM demo_keywords WHERE keyword IS NOT NULL)""",
        "lookup_cache_split": "SELECT DISTINCT keyword FROM demo_keywords WHERE keyword IS NOT NULL AND keyword NOT IN (SELECT keyword FROM keyword_context WHERE keyword IS NOT NULL)",
        "lookup_batches": """WITH n AS (SELECT count(DISTINCT keyword) AS n FROM demo_keywords), b AS (SELECT unnest(range(0, ceil(n / 1000)::BIGINT)) AS batch_no, n FROM n)
            SELECT batch_no, least(1000, n - batch_no * 1000) AS n FROM b""",
        "lookup_merge": """WITH r AS (SELECT keyword, arg_max(search_intent, context_id) AS intent FROM keyword_context WHERE search_intent IS NOT NULL GROUP BY keyword)
            SELECT row_id, coalesce(r.intent, k.intent) AS intent FROM demo_keywords k LEFT JOIN r USING (keyword)""",
        "lookup_stats": """WITH k AS (SELECT DISTINCT keyword FROM demo_keywords WHERE keyword IS NOT NULL),
            t AS (SELECT count(*) AS total, count(*) FILTER (keyword IN (SELECT keyword FROM keyword_context WHERE keyword IS NOT NULL)) AS hits FROM k)
            SELECT total, hits, total - hits AS misses, ceil((total - hits) / 1000)::BIGINT AS batches, round(hits / total, 6)::DOUBLE AS hit_ratio FROM t""",
        "answers_parsed": "SELECT file_id, line_no, count(*) AS n FROM feed_rows GROUP BY ALL",
        "answers_repaired": "SELECT file_id, line_no, count(*) AS n FROM feed_rows GROUP BY ALL",
        "relevance_distribution": """SELECT count(*) FILTER (NOT coalesce(requires_ai, false) AND brand IS NOT NULL) AS relevant,
            count(*) FILTER (NOT coalesce(requires_ai, false) AND brand IS NULL) AS irrelevant, count(*) FILTER (requires_ai) AS uncertain FROM keyword_context""",
        "quality_distribution": """SELECT count(*) FILTER (c >= 0.9) AS excellent, count(*) FILTER (c >= 0.75 AND c < 0.9) AS good, count(*) FILTER (c >= 0.5 AND c < 0.75) AS fair,
            count(*) FILTER (c < 0.5) AS poor, count(*) FILTER (c IS NULL) AS unknown FROM (SELECT nullif(business_confidence, 'nan'::DOUBLE) AS c FROM keyword_context)""",
        "accounting_check": """SELECT count(*) AS total, count(brand) AS by_brand, count(*) FILTER (brand IS NULL AND category IS NOT NULL) AS by_category_alone,
            count(*) FILTER (brand IS NULL AND category IS NULL) AS by_none, true AS balanced FROM keyword_context""",
        "key_figures": """SELECT 'rows' AS metric, count(*) AS n FROM keyword_context UNION ALL SELECT 'distinct_company_id', count(DISTINCT company_id) FROM keyword_context
            UNION ALL SELECT 'needs_review', count(*) FROM keyword_context WHERE requires_ai UNION ALL SELECT 'settled', count(*) FROM keyword_context WHERE NOT requires_ai
            UNION ALL SELECT 'with_brand', count(brand) FROM keyword_context""",
        "dataset_stats": "SELECT count(*) AS total, count(DISTINCT keyword) AS n_unique, count(*) - count(DISTINCT keyword) AS duplicates FROM demo_keywords",
        "intent_distribution": "SELECT " + ", ".join(f"count(*) FILTER (intent = '{i}') AS {i}" for i in _INTENTS) + " FROM demo_keywords",
        "category_distribution": "SELECT category, count(*) AS n FROM keyword_context WHERE category IS NOT NULL GROUP BY category",
        "reconciliation": "SELECT deterministic_reason, requires_ai, count(*) AS n FROM keyword_context WHERE deterministic_reason IS NOT NULL AND requires_ai IS NOT NULL GROUP BY ALL",
        "volume_stats": """SELECT round(coalesce(avg(search_volume), 0), 4) AS mean, coalesce(median(search_volume), 0)::DOUBLE AS median, coalesce(min(search_volume), 0)::DOUBLE AS least,
            coalesce(max(search_volume), 0)::DOUBLE AS most, count(search_volume) AS n_valid, count(*) - count(search_volume) AS n_missing FROM demo_keywords""",
        "top_keywords": "SELECT row_id, keyword, search_volume FROM demo_keywords WHERE search_volume IS NOT NULL ORDER BY search_volume DESC, row_id LIMIT 10",
        "top_category": "SELECT category AS value, count(*) AS n FROM keyword_context WHERE category IS NOT NULL GROUP BY category ORDER BY n DESC, category LIMIT 1",
        "dominant_intent": f"""SELECT coalesce((SELECT intent FROM demo_keywords WHERE intent IN {_INTENTS} GROUP BY intent
            ORDER BY count(*) DESC, list_position({list(_INTENTS)}, intent) LIMIT 1), '') AS value""",
        "mean_confidence": "SELECT round(avg(business_confidence), 6) AS mean FROM keyword_context",
        "run_summary": "SELECT count(*) AS total, count(brand) AS with_brand, count(category) AS with_category, count(*) FILTER (requires_ai) AS needs_ai FROM keyword_context",
        "health_report": "WITH s AS (SELECT count(*) AS t, count(brand) AS b, count(category) AS c, count(*) FILTER (requires_ai) AS a FROM keyword_context) SELECT "
        + ", ".join(f"CASE WHEN t > 0 THEN printf('%.1f', round({x} * 100.0 / t, 1)) || '%' ELSE '0.0%' END AS {n}_pct" for x, n in (("b", "with_brand"), ("c", "with_category"), ("a", "needs_ai")))
        + " FROM s",
        "quality_gates": """SELECT unnest(['has_rows', 'confidence_in_range', 'required_columns']) AS gate, unnest([count(*) > 0,
            count(*) FILTER (NOT coalesce(business_confidence BETWEEN 0 AND 1 AND NOT isnan(business_confidence), false)) = 0, true]) AS passed FROM keyword_context""",
        "out_of_range": "SELECT context_id FROM keyword_context WHERE NOT coalesce(business_confidence BETWEEN 0.5 AND 0.95 AND NOT isnan(business_confidence), false)",
        "event_timers": "SELECT event_type AS metric, count(*) AS n, round(avg(value), 4) AS mean, max(value) AS most FROM events GROUP BY event_type",
        "export_view": "SELECT context_id, keyword, brand IS NOT NULL AS relevant, round(business_confidence, 2) AS confidence FROM keyword_context",
    }
    return found


def _brand() -> str:
    x = "company_name"
    for p in profile.BRAND_NOISE:
        x = f"regexp_replace({x}, '(?i){p}', '', 'g')"
    return f"SELECT company_id, trim({x}, ' -') AS brand FROM companies"

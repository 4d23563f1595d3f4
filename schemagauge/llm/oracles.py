"""SQL counterparts of the queries which SQL can express."""

from __future__ import annotations

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fold(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_UPPER.lower()}')"


def dedup_sql(source: str, name: str = "dedup") -> str:
    """CTEs that end in ``name``: doc_id, n_lines, n_dropped, kept."""
    return f"""
    {name}_lines AS (
        SELECT doc_id, line, pos,
               {fold(f"trim(line, {_SPACES})")} AS k
        FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                     generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
              FROM {source})),
    {name}_keys AS (
        SELECT k, max(doc_id) AS keeper FROM {name}_lines WHERE length(k) >= 40
        GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
    {name} AS (
        SELECT doc_id, count(*) AS n_lines,
               count(*) FILTER (keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
               coalesce(string_agg(line, chr(10) ORDER BY pos)
                        FILTER (keeper IS NULL OR keeper = doc_id), '') AS kept
        FROM {name}_lines LEFT JOIN {name}_keys USING (k) GROUP BY doc_id)"""


_WHITE = "'[\\x20\\x09-\\x0D]+'"


def words_sql(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), {_WHITE}), lambda x: x <> '')"


def shingles_sql(table: str, key: str, name: str, k: int = 5) -> str:
    """CTEs that end in ``name``: the distinct shingles s of each key."""
    return f"""
    {name}_words AS (SELECT {key}, {words_sql(fold("text"))} AS w FROM {table}),
    {name} AS (
        SELECT DISTINCT {key}, unnest(CASE
            WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k - 2}),
                                                   lambda i: array_to_string(w[i : i + {k - 1}], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
        FROM {name}_words)"""


ORACLES = {
    "op2_line_dedup": f"""
    WITH {dedup_sql("documents")}
    SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM dedup""",
    "op3_chat": """
    WITH once AS (
        SELECT DISTINCT conv_id, turn, role, text FROM conversations),
    numbered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id
            ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS k FROM once),
    steps AS (
        SELECT conv_id, k, {'r': role, 't': text} AS step FROM numbered),
    snapshots AS (
        SELECT conv_id, k,
               list(step) OVER (PARTITION BY conv_id ORDER BY k
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS steps,
               k = max(k) OVER (PARTITION BY conv_id) AS whole
        FROM steps),
    hashed AS (SELECT conv_id, k, whole, md5(steps::VARCHAR) AS h FROM snapshots),
    kept AS (
        SELECT min(conv_id) AS conv_id, k AS n_turns, count(*) AS n_equal
        FROM hashed WHERE whole AND NOT EXISTS (
            SELECT 1 FROM hashed AS p WHERE NOT p.whole AND p.h = hashed.h)
        GROUP BY h, k)
    SELECT conv_id, n_turns, n_equal,
           string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '<\\|') || chr(10)
                      || replace(coalesce(text, ''), '<|', '<\\|') || '<|im_end|>' || chr(10),
                      '' ORDER BY k) AS rendered
    FROM kept JOIN numbered USING (conv_id) GROUP BY ALL""",
    "op5_decontamination": f"""
    WITH {shingles_sql("documents", "doc_id", "d")}, {shingles_sql("benchmark", "item_id", "b")},
    sizes AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
    SELECT doc_id, item_id, n_item, count(*) AS n_common
    FROM d JOIN b USING (s) JOIN sizes USING (item_id)
    GROUP BY ALL HAVING 100 * count(*) >= 75 * n_item""",
    "op9_quality_rules": f"""
    WITH w AS (
        SELECT doc_id, source, coalesce(text, '') AS text, {words_sql("text")} AS w FROM documents),
    windows AS (
        SELECT doc_id, unnest(range(1, len(w) - 1)) AS i,
               unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS s
        FROM w),
    twice AS (SELECT doc_id, s FROM windows GROUP BY ALL HAVING count(*) > 1),
    inside AS (
        SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words
        FROM windows JOIN twice USING (doc_id, s), range(3) AS r(j) GROUP BY doc_id),
    lines AS (
        SELECT doc_id, source, line, len({words_sql("line")}) AS n,
               array_to_string({words_sql(fold("line"))}, ' ') AS k
        FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM w)),
    again AS (
        SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
        FROM lines WHERE n > 0 GROUP BY doc_id),
    hosts AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source),
    common AS (
        SELECT source, k, min(doc_id) AS keeper FROM lines JOIN hosts USING (source) WHERE n > 0
        GROUP BY source, k, pages
        HAVING count(DISTINCT doc_id) > 10 AND count(DISTINCT doc_id) > 0.25 * pages),
    removed AS (
        SELECT doc_id, sum(n) AS n_removed FROM lines JOIN common USING (source, k)
        WHERE doc_id <> keeper GROUP BY doc_id),
    measured AS (
        SELECT doc_id, len(w) AS n_words,
               coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
               length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
               coalesce(n_dup_lines, 0) AS n_dup_lines,
               coalesce(n_repeat_words, 0) AS n_repeat_words,
               coalesce(n_removed, 0) AS n_removed
        FROM w LEFT JOIN inside USING (doc_id) LEFT JOIN again USING (doc_id)
        LEFT JOIN removed USING (doc_id))
    SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_removed::BIGINT AS n_removed,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
               AND n_words - n_removed >= 0.5 * n_words AS kept
    FROM measured""",
    "op10_near_dedup": f"""
    WITH RECURSIVE {shingles_sql("documents", "doc_id", "d")},
    sizes AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
    links AS (
        SELECT x.doc_id AS a, y.doc_id AS b
        FROM d AS x JOIN d AS y ON x.s = y.s AND x.doc_id <> y.doc_id
        JOIN sizes AS p ON p.doc_id = x.doc_id JOIN sizes AS q ON q.doc_id = y.doc_id
        GROUP BY x.doc_id, y.doc_id, p.n, q.n
        HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
    reach(a, b) AS (
        SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    least AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles,
           least(coalesce(c, doc_id), doc_id) AS component_id,
           doc_id <= coalesce(c, doc_id) AS kept
    FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)""",
    "op11_warc": """
    WITH p AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
    d AS (
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '')
                   AS payload_digest,
               max(page_id) OVER (PARTITION BY h, payload_bytes) AS leader
        FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> leader THEN leader END AS refers_to
    FROM d""",
    "op12_divergence": f"""
    WITH d AS (
        SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all({fold("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t
        FROM documents),
    occurrences AS (SELECT r, lang, source, unnest(t) AS term FROM d),
    kept AS (
        SELECT lang, term, count(*) AS lang_n FROM occurrences GROUP BY ALL HAVING count(DISTINCT r) >= 3),
    langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
    groups AS (SELECT DISTINCT lang, source FROM d),
    own AS (
        SELECT lang, source, term, count(*) AS n FROM occurrences SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    given AS (
        SELECT lang, source, term, lang_n, lang_total, v, coalesce(n, 0) AS n,
               sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS total
        FROM groups JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN own USING (lang, source, term)),
    shares AS (
        SELECT lang, source, term, n,
               (1 + (1000000000::HUGEINT * (n + 1)) // (total + v))::BIGINT AS p,
               (1 + (1000000000::HUGEINT * (lang_n + 1)) // (lang_total + v))::BIGINT AS q
        FROM given),
    sums AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
        FROM shares AS a JOIN shares AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
        GROUP BY ALL),
    parts AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
        FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
    SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
}

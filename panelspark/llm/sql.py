"""DuckDB SQL of the registered queries that SQL can express."""
from __future__ import annotations

from panelspark.llm import quality_rules as rules, secrets, url_filter as urls

_WORD = r"[^\x20\x09-\x0D]+"


def _phrases() -> str:
    return " OR ".join(f"contains(lower(line), '{p}')" for p in rules.BOILERPLATE)


# Rows of documents are numbered, so that repeated ids stay apart. A caller puts its table in place of documents.
RULES_CTES = rf"""
src AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS body FROM documents),
toks AS (SELECT rid, regexp_extract_all(body, '{_WORD}') AS w FROM src),
pos AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM toks),
win AS (SELECT rid, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM pos
        WINDOW o AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i FROM win WHERE c IS NOT NULL
        QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
cov AS (SELECT rid, count(DISTINCT i + d) AS n FROM rep, (VALUES (0), (1), (2)) t(d) GROUP BY rid),
lines AS (SELECT rid, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS k FROM (
          SELECT rid, string_split(body, chr(10)) AS l FROM src)),
facts AS (SELECT *, regexp_extract_all(line, '{_WORD}') AS lw FROM lines),
bad AS (SELECT rid, k, line, len(lw) > 0 AS wordy, len(lw) > 0 AND (
          100 * (length(line) - length(regexp_replace(line, '{rules.SYMBOLS}', '', 'g'))) > {rules.SYMBOL_PERCENT} * len(lw)
          OR 100 * (length(line) - length(regexp_replace(line, '!!|\?\?', '', 'g'))) / 2 > {rules.SHOUT_PERCENT} * len(lw)
          OR 100 * len(list_filter(lw, lambda x: x IN ('|', '·', '»', '›', '>'))) > {rules.BAR_PERCENT} * len(lw)
          OR (len(lw) < {rules.SHORT_LINE} AND NOT regexp_matches(rtrim(line, ' '), '{rules.CLOSING.replace("'", "''")}'))
          OR {_phrases()}) AS fails FROM facts),
judged AS (SELECT rid,
          count(*) FILTER (wordy) - count(DISTINCT line) FILTER (wordy) AS n_dup_lines,
          coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) FILTER (fails), 0)::BIGINT AS lost_chars,
          string_agg(line, chr(10) ORDER BY k) FILTER (NOT fails) AS clean_text
          FROM bad GROUP BY rid),
ruled AS (SELECT src.* EXCLUDE (body, rid), len(w)::BIGINT AS n_words,
          length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
          (length(body) - length(regexp_replace(body, '{rules.SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
          n_dup_lines::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
          len(w) < {rules.MIN_WORDS} OR 100 * coalesce(n, 0) > {rules.MAX_REPEAT_PERCENT} * len(w) AS base_failed,
          lost_chars, clean_text
          FROM src JOIN toks USING (rid) JOIN judged USING (rid) LEFT JOIN cov USING (rid))
"""

OP1 = f"""WITH {RULES_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars,
       NOT base_failed AND 100 * lost_chars <= {rules.MAX_LOST_PERCENT} * word_chars AS kept
FROM ruled"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_URL_RULES = ", ".join(f"('{r.name}', '{r.verdict}', '{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}')"
                       for r in urls.HOST_RULES)
_URL_WORDS = ", ".join(f"('{r.name}', '{'[.-]'.join(r.tokens)}')" for r in urls.WORD_RULES)

OP6 = rf"""WITH cut AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://')
    THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT rid, page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM cut),
split AS (SELECT rid, page_id, translate(h, '{_UPPER}', '{_UPPER.lower()}') AS host,
    regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM parts),
rules(rule, verdict, rh, rp) AS (VALUES {_URL_RULES}),
best AS (SELECT rid, rule, rules.verdict FROM split JOIN rules
    ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
    QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC) = 1),
words(word, body) AS (VALUES {_URL_WORDS}),
hit AS (SELECT rid, min(word) AS word FROM split JOIN words
    ON regexp_matches(host, '(^|[.-])' || body || '($|[^a-z0-9])') GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN word IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN rule IS NULL THEN word END AS pattern
FROM split LEFT JOIN best USING (rid) LEFT JOIN hit USING (rid)"""

# Every pair of documents with a common shingle, linked at 75 %, then the smallest id reachable. A stack of copies
# shares its shingles, so copies are one class here too. Rows without an id and blank texts stand alone.
OP3 = rf"""WITH RECURSIVE src AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
    '{_WORD}') AS w FROM documents),
class AS MATERIALIZED (SELECT row_number() OVER () AS c, w, min(doc_id) AS rep FROM src WHERE len(w) > 0 GROUP BY w),
places AS (SELECT c, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM class),
each AS MATERIALIZED (SELECT DISTINCT c, array_to_string(w[i:i + 4], ' ') AS s FROM places),
sizes AS MATERIALIZED (SELECT c, count(*) AS n FROM each GROUP BY c),
common AS MATERIALIZED (SELECT s, dense_rank() OVER (ORDER BY s) AS k FROM each GROUP BY s HAVING count(*) > 1),
shared AS MATERIALIZED (SELECT c, rep, k FROM each JOIN common USING (s) JOIN class USING (c) WHERE rep IS NOT NULL),
pairs AS MATERIALIZED (SELECT a.rep AS x, b.rep AS y FROM shared a JOIN shared b ON a.k = b.k AND a.c <> b.c
    JOIN sizes m ON m.c = a.c JOIN sizes n ON n.c = b.c
    GROUP BY a.c, b.c, a.rep, b.rep, m.n, n.n HAVING 100 * count(*) >= 75 * (m.n + n.n - count(*))),
reach AS (SELECT DISTINCT x, x AS y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON p.x = r.y),
parts AS (SELECT x, min(y) AS component FROM reach GROUP BY x)
SELECT doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles,
       CASE WHEN doc_id IS NOT NULL THEN coalesce(p.component, k.rep, doc_id) END AS component_id,
       coalesce(doc_id = coalesce(p.component, k.rep, doc_id), true) AS kept
FROM src LEFT JOIN class k ON k.w = src.w LEFT JOIN sizes z ON z.c = k.c LEFT JOIN parts p ON p.x = k.rep"""


def _quoted(text: str) -> str:
    return text.replace("'", "''")


_SECRET_HITS = "\nUNION ALL ".join(
    f"SELECT rid, {rank} AS rank, '{r.kind}' AS kind, regexp_extract_all(body, '{_quoted(r.pattern)}') AS h, "
    f"regexp_split_to_array(body, '{_quoted(r.pattern)}') AS g FROM src" for rank, r in enumerate(secrets.RULES))
_SECRET_LEAST = " ".join(f"WHEN rank = {rank} THEN length(regexp_replace(hit, '{_quoted(r.group)}', '')) >= {r.least}"
                         for rank, r in enumerate(secrets.RULES) if r.least)

OP8 = rf"""WITH src AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
hits AS ({_SECRET_HITS}),
each AS (SELECT rid, rank, kind, h, g, unnest(range(1, len(h) + 1)) AS i FROM hits),
spots AS (SELECT rid, rank, kind, h[i] AS hit, coalesce(list_sum([length(x) FOR x IN g[1:i]]), 0)
    + coalesce(list_sum([length(x) FOR x IN h[1:i - 1]]), 0) AS start FROM each),
spans AS (SELECT rid, rank, kind, start, kind || ':' || start::BIGINT || ':' || (start + length(hit))::BIGINT AS span FROM spots
    WHERE CASE {_SECRET_LEAST} ELSE true END),
joined AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
    string_agg(span, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM src LEFT JOIN joined USING (rid)"""

OP10 = """WITH given AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
coded AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS top
    FROM given),
fives AS (SELECT *, [('0x' || substr(h, (k * 5 + 1)::INTEGER, 5))::BIGINT FOR k IN range(0, 8)] AS bits FROM coded)
SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((bits[(j // 4 + 1)::INTEGER] >> (15 - 5 * (j % 4))::INTEGER) & 31) + 1)::INTEGER, 1) FOR j IN range(0, 32)], '') AS payload_digest,
       CASE WHEN top IS NULL OR page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM fives"""

# The trie by grouping prefixes. crc32 goes bit by bit over the decimal digits; a prefix is named by a hash of its turns.
OP13 = """
WITH turns AS (
    SELECT conv_id, list({'k': sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')),
                          'n': length(coalesce(text, ''))}
                         ORDER BY turn NULLS FIRST, coalesce(role, ''),
                                  sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS t
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), hashed AS (
    SELECT conv_id, t, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
        lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]),
            lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS BIGINT) % 6 AS h
    FROM turns
), rebuilt AS (
    SELECT c.conv_id, list_concat(list_slice(coalesce(b.t, []), 1, c.h), list_slice(c.t, c.h + 1, len(c.t))) AS t
    FROM hashed c LEFT JOIN turns b ON b.conv_id = c.conv_id - c.conv_id % 100
), prefixes AS (
    SELECT conv_id, len(t) AS size, d, CASE WHEN d > 0 THEN t[d].n ELSE 0 END AS chars,
           sha256(array_to_string(list_transform(list_slice(t, 1, d), lambda x: x.k), '')) AS k,
           sha256(array_to_string(list_transform(list_slice(t, 1, d - 1), lambda x: x.k), '')) AS up
    FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT d, k, any_value(up) AS up, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends
    FROM prefixes GROUP BY d, k
), kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
lines AS (
    SELECT n.d, n.k, a.d AS top_d, a.k AS top_k
    FROM nodes n JOIN (SELECT DISTINCT conv_id, d, k FROM prefixes) a ON a.conv_id = n.conv_id AND a.d <= n.d
), sums AS (
    SELECT l.top_d AS d, l.top_k AS k, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
    FROM lines l JOIN nodes n ON n.d = l.d AND n.k = l.k LEFT JOIN kids c ON c.d = n.d AND c.k = n.k GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children,
       s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.k = n.k LEFT JOIN kids c ON c.d = n.d AND c.k = n.k
LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.k = n.up
"""

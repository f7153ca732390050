"""The same results as plain SQL, without anchors, shards or digests of the operators' own."""

from __future__ import annotations

from string import Template

from costurero.llm import url_filter

#: Windows of fifty words that also start in a document with a smaller doc_id.
PASSAGES = r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
windows AS (
    SELECT doc_id, u.i AS i, u.h AS h FROM (
        SELECT doc_id, unnest(list_transform(range(1, len(w) - 48), lambda i: {'i': i, 'h': md5(array_to_string(w[i:i + 49], ' '))})) AS u
        FROM d WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS first_doc FROM windows GROUP BY h),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (h) WHERE doc_id > first_doc),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hits)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
    SELECT words.doc_id, COUNT(*) FILTER (WHERE gone.p IS NOT NULL) AS n_removed,
           string_agg(x, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS t
    FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

#: Strings of 400 bytes that start at two places or more.
BYTES = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (
    SELECT doc_id, u.i AS i, u.h AS h FROM (
        SELECT doc_id, unnest(list_transform(range(1, octet_length(b) - 398), lambda i: {'i': i, 'h': md5(b[i:i + 399])})) AS u
        FROM d WHERE octet_length(b) >= 400)),
hits AS (SELECT doc_id, i FROM windows JOIN (SELECT h FROM windows GROUP BY h HAVING COUNT(*) > 1) USING (h)),
marked AS (
    SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS opens FROM hits),
spans AS (
    SELECT doc_id, MIN(i) AS a, MAX(i) + 399 AS z
    FROM (SELECT doc_id, i, SUM(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked) GROUP BY doc_id, span),
gaps AS (
    SELECT doc_id, z + 1 AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a) - 1, 9223372036854775807) AS z FROM spans
    UNION ALL SELECT doc_id, 1, MIN(a) - 1 FROM spans GROUP BY doc_id),
kept AS (
    SELECT doc_id, unhex(string_agg(hex(b[gaps.a:least(gaps.z, octet_length(b))]), '' ORDER BY gaps.a)) AS k
    FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, SUM(z - a + 1) AS n_removed, COUNT(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(k, b)) AS kept_sha256
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

#: Rules first; for the rest the regression, its weights travelling with the rows of the labelled URLs' n-grams.
URLS = r"""
WITH RECURSIVE
words AS (SELECT unnest(string_split($unwanted, ' ')) AS w, 1.0 AS y UNION ALL SELECT unnest(string_split($wanted, ' ')), 0.0),
hosts AS (SELECT unnest(range(len(h))) AS i, unnest(h) AS host FROM (SELECT string_split($hosts, ' ') AS h)),
labelled AS (
    SELECT url, max(y) AS y FROM (
        SELECT 'https://' || replace(host, '{}', w) || string_split($paths, ' ')[(i + length(w)) % $n_paths + 1] AS url, y
        FROM words, hosts) GROUP BY url),
parted AS (
    SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM (
        SELECT 0 AS kind, 0 AS page_id, url, y FROM labelled UNION ALL SELECT 1, page_id, url, NULL FROM pages))),
numbered AS (SELECT *, row_number() OVER () AS row_id FROM parted),
folded AS (SELECT kind, row_id, y, lower(regexp_replace('^' || host || '$' || path || '|', '[0-9]+', '0', 'g')) AS t, host, path FROM numbered),
grams AS (
    SELECT DISTINCT kind, row_id, y, ('0x' || right(md5(substr(t, u.i, u.n)), 8))::BIGINT % $buckets AS b FROM (
        SELECT *, unnest(flatten(list_transform(range($shortest, $longest + 1), lambda n:
            list_transform(range(1, length(t) - n + 2), lambda i: {'i': i, 'n': n})))) AS u
        FROM folded WHERE host <> '' OR path <> '')),
features AS (SELECT row_id, y, b FROM grams WHERE kind = 0 UNION ALL SELECT row_id, y, -1 FROM folded WHERE kind = 0),
fit AS (
    SELECT 0 AS k, row_id, y, b, 0::DOUBLE AS w FROM features
    UNION ALL
    SELECT k + 1, row_id, y, b,
           w * CASE WHEN b < 0 THEN 1 ELSE 1 - $decay END + $rate / (SELECT count(*) FROM labelled) * sum(e) OVER (PARTITION BY b)
    FROM (SELECT *, y - 1 / (1 + exp(-sum(w) OVER (PARTITION BY row_id))) AS e FROM fit WHERE k < $rounds)),
weights AS (SELECT b, any_value(w) AS w FROM fit WHERE k = $rounds GROUP BY b),
prior AS (SELECT ln($share / (1 - $share)) - ln(sum(y) / (count(*) - sum(y))) AS shift FROM labelled),
scores AS (SELECT row_id, sum(w) AS total FROM grams JOIN weights USING (b) WHERE kind = 1 GROUP BY row_id),
ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM numbered WHERE kind = 1)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN 1 / (1 + exp(-(coalesce(total, 0) + (SELECT w FROM weights WHERE b = -1) + (SELECT shift FROM prior)))) >= $least
            THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN scores USING (row_id)
"""

#: Cuts between code points, from the hash of the id.
FILL_MIDDLE = r"""
WITH h AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
           list_transform(range(4), lambda i: ('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), i * 8 + 1, 8))::BIGINT) AS h
    FROM documents),
c AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
           CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM h),
p AS (SELECT *, left(t, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

#: Every survivor of every state with its whole edits and output, compared as they are.
TURNS = r"""
WITH RECURSIVE
sums AS (
    SELECT *, list_reduce([4294967295] || list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT), lambda c, b:
        list_reduce([xor(c, b)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
    FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)),
faults AS (SELECT *, xor(crc, 4294967295) % 20 AS f FROM sums),
damaged AS (
    SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
           CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM faults, range(2) AS copies(copy) WHERE f <> 0 AND (copy = 0 OR f = 3)),
ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth,
           regexp_replace(text, '[ 	-
]+$', '') AS rest FROM damaged),
marked AS (
    SELECT *, CASE WHEN rest = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(rest, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
           left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM ordered),
counted AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
           count_if(before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
    FROM marked GROUP BY conv_id),
moves(s, initial, letters, price, t, inserted, given) AS (VALUES
    (0, 's', 'K', 0, 1, NULL, NULL), (0, 'u', 'K', 0, 2, NULL, NULL), (0, NULL, 'R', 3, 2, NULL, 'user'),
    (0, 'a', 'IK', 3, 3, 'user', NULL), (0, NULL, 'IR', 6, 3, 'user', 'assistant'),
    (1, 'u', 'K', 0, 2, NULL, NULL), (1, NULL, 'R', 3, 2, NULL, 'user'),
    (1, 'a', 'IK', 3, 3, 'user', NULL), (1, NULL, 'IR', 6, 3, 'user', 'assistant'),
    (2, 'a', 'K', 0, 3, NULL, NULL), (2, NULL, 'R', 3, 3, NULL, 'assistant'),
    (2, 'u', 'IK', 3, 2, 'assistant', NULL), (2, NULL, 'IR', 6, 2, 'assistant', 'user'),
    (3, 'u', 'K', 0, 2, NULL, NULL), (3, NULL, 'R', 3, 2, NULL, 'user'),
    (3, 'a', 'IK', 3, 3, 'user', NULL), (3, NULL, 'IR', 6, 3, 'user', 'assistant'),
    (0, NULL, 'D', 4, 0, NULL, NULL), (1, NULL, 'D', 4, 1, NULL, NULL), (2, NULL, 'D', 4, 2, NULL, NULL), (3, NULL, 'D', 4, 3, NULL, NULL)),
ways AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS made FROM counted
    UNION ALL
    SELECT conv_id, i, s, cost, audit, made FROM (
        SELECT w.conv_id, w.i + 1 AS i, m.t AS s,
               w.cost + m.price + CASE WHEN r.fault = 'truncated' AND m.letters <> 'D' THEN 3 ELSE 0 END AS cost,
               w.audit || m.letters AS audit,
               w.made || CASE WHEN m.inserted IS NULL THEN [] ELSE [m.inserted || ':'] END
                      || CASE WHEN m.letters = 'D' THEN [] ELSE [coalesce(m.given, r.role) || ':' || r.text] END AS made
        FROM ways w JOIN marked r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
        JOIN moves m ON m.s = w.s AND (m.initial IS NULL OR m.initial = r.c)
        WHERE m.letters = 'D' OR r.fault IS NULL OR r.fault = 'truncated')
    QUALIFY row_number() OVER (PARTITION BY conv_id, i, s ORDER BY cost, audit) = 1),
ended AS (
    SELECT w.conv_id, cost + CASE s WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END AS cost,
           audit || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
           made || CASE s WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END AS made
    FROM ways w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i),
best AS (SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def with_settings(sql: str) -> str:
    """The statement on URLs with the operator's words and settings written in."""
    s = url_filter.Settings()
    texts = {"unwanted": url_filter.UNWANTED, "wanted": url_filter.WANTED, "hosts": url_filter.HOSTS, "paths": url_filter.PATHS}
    values = {name: f"'{' '.join(words)}'" for name, words in texts.items()} | {"n_paths": len(url_filter.PATHS)}
    numbers = ("buckets", "shortest", "longest", "rounds", "rate", "decay", "share", "least")
    return Template(sql).safe_substitute(values | {n: repr(getattr(s, n)) for n in numbers})


ORACLE_SQL: dict[str, str] = {
    "op6_suffix_array": BYTES,
    "op7_passages": PASSAGES,
    "op11_url_filter": with_settings(URLS),
    "op12_fill_middle": FILL_MIDDLE,
    "op13_turn_repair": TURNS,
}

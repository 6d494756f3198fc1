"""DuckDB SQL of the operators that SQL can express, each by a plainer way than the
operator itself: line text instead of hashes, joins over all rows instead of an index."""

from __future__ import annotations

_SPACE = "[\\x20\\x09-\\x0D]+"
_WORD = "[^\\x20\\x09-\\x0D]+"

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{_WORD}') AS ws, string_split(t, chr(10)) AS ls, t FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g
        FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY r),
ln AS (SELECT r, l, regexp_extract_all(l, '{_WORD}') AS lw FROM (SELECT r, unnest(ls) AS l FROM w)),
lines AS (SELECT ln.r, d.source, l, len(lw) AS n,
                 array_to_string(regexp_extract_all(regexp_replace(lower(l), '[0-9]', '0', 'g'), '{_WORD}'), ' ') AS norm
          FROM ln JOIN d USING (r) WHERE len(lw) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY r),
host AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
often AS (SELECT source, norm FROM lines JOIN host USING (source) GROUP BY source, norm, docs
          HAVING count(DISTINCT r) > 10 AND count(DISTINCT r) > 0.01 * docs),
gone AS (SELECT r, sum(n) AS n FROM lines JOIN often USING (source, norm) GROUP BY r),
base AS (SELECT d.r, d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
                CAST(length(regexp_replace(d.t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
                CAST(length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
                CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
         FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN covered USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND n_words - removed_words >= 0.3 * n_words AS kept
FROM base
"""

OP5 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
             CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                  WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM s),
rounds AS (
  SELECT 0 AS k, 0.0::DOUBLE AS level
  UNION ALL
  SELECT k + 1, (1.5::DOUBLE * (SELECT sum(source_size) FROM w)
                 - (SELECT coalesce(sum(cap), 0.0) FROM w WHERE weight * level >= cap))
                / (SELECT sum(weight) FROM w WHERE weight * level < cap)
  FROM rounds WHERE k < 40 AND EXISTS (SELECT 1 FROM w WHERE weight * level < cap)),
goal AS (SELECT source, source_size,
                least(weight * (SELECT level FROM rounds WHERE level IS NOT NULL ORDER BY k DESC LIMIT 1), cap) AS target FROM w),
p AS (SELECT doc_id, source, size,
             row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS place FROM d),
x AS (SELECT p.doc_id, p.size, g.source_size, g.target, place,
             CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS each,
             CAST('0x' || substr(md5('20:' || coalesce(p.source, '')), 1, 5) AS BIGINT) / 1048576.0::DOUBLE AS o
      FROM p JOIN goal g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(floor(each * (place + 1) + o) - floor(each * place + o), ceil(each)) AS BIGINT) AS taken
FROM x
"""

OP9 = """
WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64),
pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
                 CAST(len(list_filter(range(1, 65), lambda i: (q.embedding[i] > 0) <> (v.embedding[i] > 0))) AS INTEGER) AS distance
          FROM v q CROSS JOIN v WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= 10
"""

# Offsets of the matches of one pattern: pieces before them and their own lengths, summed.
def _spans(kind: str, pattern: str, ok: str) -> str:
    return f"""
{kind} AS (SELECT r, '{kind}' AS kind, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM (
  SELECT r, ms[i] AS m, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT r, ms, ps, unnest(range(1, len(ms) + 1)) AS i
        FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM d))) x
  WHERE {ok})"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
  CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST(substr({_DIGITS}, CAST(i AS INTEGER), 1) AS INTEGER)
       WHEN CAST(substr({_DIGITS}, CAST(i AS INTEGER), 1) AS INTEGER) > 4
       THEN 2 * CAST(substr({_DIGITS}, CAST(i AS INTEGER), 1) AS INTEGER) - 9
       ELSE 2 * CAST(substr({_DIGITS}, CAST(i AS INTEGER), 1) AS INTEGER) END)) % 10 = 0"""

#: The contract's base columns; the further spans of the method have tests of their own.
OP4_BASE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{_spans('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', 'true')},
{_spans('ip', '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+',
        "len(list_filter(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0")},
{_spans('card', '[0-9](?:[ -]?[0-9])+', f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}")},
{_spans('phone', '[+][0-9][ ().0-9-]+[0-9]', f"length({_DIGITS}) BETWEEN 8 AND 15")},
a AS (SELECT *, 1 AS k FROM email UNION ALL SELECT *, 2 FROM ip UNION ALL SELECT *, 3 FROM card UNION ALL SELECT *, 4 FROM phone),
g AS (SELECT r, count(*) FILTER (k = 1) AS n_email, count(*) FILTER (k = 2) AS n_ip, count(*) FILTER (k = 3) AS n_card,
             count(*) FILTER (k = 4) AS n_phone, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans FROM a GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN g USING (r)
"""

OP7 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
k AS (SELECT html, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY html HAVING count(*) > 1),
u AS (SELECT page_id, lower(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://|#[^#]*$', '', 'g')) AS x FROM p),
h AS (SELECT page_id, x, regexp_replace(regexp_extract(x, '^([^/?]*)', 1), ':[0-9]*$', '') AS host,
             regexp_replace(x, '^[^/?]*', '') AS rest FROM u)
SELECT p.page_id, payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN keep IS NOT NULL AND keep <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep <> p.page_id THEN keep END AS refers_to,
       CASE WHEN x = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || rest END AS url_key,
       strftime(TIMESTAMP '2024-01-01' + to_seconds(p.page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS ts
FROM p LEFT JOIN k USING (html) JOIN h ON h.page_id = p.page_id
"""

OP11 = """
WITH n AS (SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS chars,
                  regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS plain FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(plain) AS text_sha256
FROM n WINDOW best AS (PARTITION BY plain ORDER BY chars DESC, doc_id NULLS LAST, r)
"""

OP12 = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
             CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM e AS a JOIN e AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (SELECT * FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, id) <= 5),
met AS (SELECT q.anchor_id, q.id AS positive_id, n.id AS negative_id, q.score AS positive_score, n.score AS negative_score,
               row_number() OVER (PARTITION BY q.r, q.id ORDER BY n.score DESC, n.id) AS place
        FROM positive AS q JOIN p AS n ON n.r = q.r AND NOT n.same
         AND 80 * q.score <= 100 * n.score AND 100 * n.score <= 100 * q.score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM met WHERE place <= 5
"""

ORACLES: dict[str, str] = {
    "op2_line_quality": OP2,
    "op5_source_mixture": OP5,
    "op7_warc": OP7,
    "op9_hamming_topk": OP9,
    "op11_exact_dedup": OP11,
    "op12_hard_negatives": OP12,
}

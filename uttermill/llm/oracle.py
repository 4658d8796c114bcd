"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .host_quality import (HABIT, MAX_DUP_LINE_SHARE, MAX_REPEAT_PERCENT, MAX_SYMBOLS_PER_WORD, MIN_WORDS,
                           SOFT_RULES, WORD_LENGTH)
from .line_dedup import MIN_SITES

Q: dict[str, str] = {}

Q["op2_url_filter"] = r"""
WITH captures AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes(page_id * 7919 % 43200) AS tm,
         nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.'), '') AS host
  FROM pages),
edits AS (
  SELECT event_type AS list, e.ts AS tm, user_id % 3 <> 0 AS active, host,
         CASE WHEN user_id % 2 = 1 AND len(string_split(host, '.')) > 3
              THEN array_to_string(list_slice(string_split(host, '.'), 2, 99), '.') ELSE host END AS domain
  FROM events e JOIN captures c ON c.page_id = e.event_id % (SELECT count(*) FROM pages)),
merged AS (SELECT list, domain, tm, bool_or(active) AS active FROM edits WHERE domain IS NOT NULL GROUP BY ALL),
held AS (SELECT list, domain, tm AS a, lead(tm) OVER (PARTITION BY list, domain ORDER BY tm) AS b, active FROM merged),
asked AS (
  SELECT page_id, tm, unnest(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1),
                       lambda i: array_to_string(list_slice(string_split(host, '.'), i, 99), '.'))) AS domain
  FROM captures WHERE host IS NOT NULL),
hits AS (
  SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
  FROM asked JOIN held USING (domain) WHERE active AND a <= asked.tm AND (b IS NULL OR asked.tm < b) GROUP BY page_id)
SELECT page_id, url, coalesce(lists, '') AS lists, lists IS NULL AS allowed FROM captures LEFT JOIN hits USING (page_id)
"""

Q["op7_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  ((('0x' || substr(h, 5 * i + 1, 5))::INTEGER >> (15 - 5 * j)) & 31)::INTEGER + 1, 1)), '')), '')
         AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""

Q["op9_line_dedup"] = rf"""
WITH parts AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                      generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
l AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM parts),
bad AS (SELECT t, min({{'d': doc_id, 'p': pos}}) AS first FROM l WHERE t <> ''
        GROUP BY t HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (SELECT l.*, bad.t IS NOT NULL AND {{'d': doc_id, 'p': pos}} <> bad.first AS gone
           FROM l LEFT JOIN bad ON l.t = bad.t)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""

_RATES = ", ".join(
    f"(f_{r} + m_{r} * k_{r}) / (n + k_{r}) AS r_{r}, n + k_{r} + 1 AS w_{r}" for r in SOFT_RULES)
_PRIOR = ", ".join(
    f"avg(f_{r} / n) AS m_{r}, CASE WHEN var_pop(f_{r} / n) > 0 THEN least(1000, greatest(1, avg(f_{r} / n) * "
    f"(1 - avg(f_{r} / n)) / var_pop(f_{r} / n) - 1)) ELSE 1000 END AS k_{r}" for r in SOFT_RULES)

Q["op10_host_quality"] = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
           FROM documents),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2])) AS t,
               unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2),
twice AS (SELECT doc_id, t FROM win GROUP BY doc_id, t HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM
          (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win JOIN twice USING (doc_id, t)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT x) AS d FROM
            (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM w)
          WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT doc_id, source, len(ws) AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(lines.n, 0) AS n_lines, coalesce(lines.n - lines.d, 0) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words
      FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} AS short, 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS repeats,
             n_symbols > {MAX_SYMBOLS_PER_WORD} * n_words AS symbols,
             n_dup_lines > {MAX_DUP_LINE_SHARE} * n_lines AS dup_lines,
             word_chars / greatest(n_words, 1) < {WORD_LENGTH[0]}
               OR word_chars / greatest(n_words, 1) > {WORD_LENGTH[1]} AS word_length FROM c),
h AS (SELECT source, count(*) AS n, {", ".join(f"sum({r}::INT)::DOUBLE AS f_{r}" for r in SOFT_RULES)} FROM b GROUP BY source),
m AS (SELECT {_PRIOR} FROM h),
v AS (SELECT source, {", ".join(f"r_{r} - sqrt(r_{r} * (1 - r_{r}) / w_{r}) >= {HABIT} AS bad_{r}" for r in SOFT_RULES)}
      FROM (SELECT source, {_RATES} FROM h, m))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
       NOT (short OR repeats) AND NOT ({" OR ".join(f"({r} AND bad_{r})" for r in SOFT_RULES)}) AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""


def _crc32(column: str) -> str:
    """Unsigned CRC-32 of a number's decimal digits."""
    step = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    digits = f"string_split({column}::VARCHAR, '')"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform({digits}, lambda x: "
            f"ascii(x)::BIGINT)), lambda a, b: {step}))")


def _field(column: str) -> str:
    return f"coalesce(strlen(({column})::VARCHAR) || ':' || ({column})::VARCHAR, '-')"


_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_ALTERED = _LEAF.replace("n_chars", f"n_chars + CASE WHEN {_crc32('doc_id')} % 7 = 0 THEN 1 ELSE 0 END")

Q["op12_merkle_manifest"] = rf"""
WITH RECURSIVE leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                                 count(*) OVER (PARTITION BY lang) AS n
                          FROM (SELECT doc_id, lang, sha256({_LEAF}) AS leaf, sha256({_ALTERED}) AS altered
                                FROM documents)),
tree AS (SELECT lang, 0 AS h, i, leaf AS x, n FROM leaves
         UNION ALL
         SELECT lang, h + 1, i // 2, sha256(string_agg(x, '' ORDER BY i)), (any_value(n) + 1) // 2
         FROM tree WHERE n > 1 GROUP BY lang, h, i // 2),
subroots AS (SELECT lang, x, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
             FROM tree WHERE n = 1),
crown AS (SELECT 0 AS h, i, x, n FROM subroots
          UNION ALL
          SELECT h + 1, i // 2, sha256(string_agg(x, '' ORDER BY i)), (any_value(n) + 1) // 2
          FROM crown WHERE n > 1 GROUP BY h, i // 2),
walk AS (SELECT doc_id, leaf, lang, 0 AS h, i, n, altered AS acc, '' AS proof FROM leaves
         UNION ALL
         SELECT w.doc_id, w.leaf, w.lang, w.h + 1, w.i // 2, (w.n + 1) // 2,
                sha256(CASE WHEN w.i % 2 = 0 THEN w.acc || coalesce(t.x, '') ELSE t.x || w.acc END),
                w.proof || coalesce(t.x, '')
         FROM walk w LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM w.lang AND t.h = w.h AND t.i = xor(w.i, 1)
         WHERE w.n > 1),
climb AS (SELECT doc_id, leaf, s.x AS subroot, 0 AS h, s.i, s.n, acc, proof
          FROM walk w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
          UNION ALL
          SELECT w.doc_id, w.leaf, w.subroot, w.h + 1, w.i // 2, (w.n + 1) // 2,
                 sha256(CASE WHEN w.i % 2 = 0 THEN w.acc || coalesce(t.x, '') ELSE t.x || w.acc END),
                 w.proof || coalesce(t.x, '')
          FROM climb w LEFT JOIN crown t ON t.h = w.h AND t.i = xor(w.i, 1) WHERE w.n > 1)
SELECT doc_id, leaf, subroot, x AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = x AS verified
FROM climb JOIN (SELECT x FROM crown WHERE n = 1) ON true WHERE climb.n = 1
"""

Q["op11_prefix_trie"] = rf"""
WITH own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS ts
             FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
c AS (SELECT o.conv_id, list_concat(list_slice(coalesce(f.ts, []), 1, h), list_slice(o.ts, h + 1, len(o.ts))) AS ts
      FROM (SELECT *, ({_crc32('conv_id')} % 9)::BIGINT AS h FROM own) o
      LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % 5),
p AS (SELECT conv_id, unnest(range(0, len(ts) + 1)) AS d, ts FROM c),
n AS (SELECT list_slice(ts, 1, d) AS path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
             any_value(CASE WHEN d = 0 THEN 0 ELSE strlen(ts[d].t) END) AS bytes,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(ts) = d), '')) AS ends_sha256
      FROM p GROUP BY ALL),
k AS (SELECT list_slice(path, 1, d - 1) AS path, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k USING (path)),
up AS (SELECT list_slice(path, 1, unnest(range(0, d + 1))) AS top, (n_convs - 1) * bytes AS saved,
              (n_children = 0)::BIGINT AS leaf FROM m),
sums AS (SELECT top AS path, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM up GROUP BY top)
SELECT m.conv_id, m.d AS depth, a.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN sums USING (path) LEFT JOIN m a ON m.d > 0 AND a.d = m.d - 1 AND a.path = list_slice(m.path, 1, m.d - 1)
"""

Q["op13_vector_dedup"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm
           FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
good AS (SELECT * FROM v WHERE norm > 0 AND isfinite(norm) AND len(list_filter(e, lambda x: x IS NULL)) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT links.b, c FROM reach JOIN links ON links.a = reach.vec_id),
comp AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM comp LEFT JOIN n USING (vec_id)
"""

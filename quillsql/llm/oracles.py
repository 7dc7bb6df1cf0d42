"""DuckDB SQL for the opN_ queries whose whole result SQL can state.

Plain forms, pair by pair, with none of the operators' methods: they serve small tables. Missing are the queries that
need a tokenizer (op1, op6, op9) or a trained model (op5, op7, op8).
"""

from __future__ import annotations

LINE_DEDUP = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM split),
placed AS (
  SELECT doc_id, pos, line, row_number() OVER (ORDER BY doc_id, pos) AS place,
         [w FOR w IN regexp_split_to_array(line, '[ \t\x0b\f\r]+') IF w <> ''] AS words
  FROM lines
),
firsts AS (
  SELECT array_to_string(words, ' ') AS plain, any_value(words) AS words, min(place) AS place
  FROM placed WHERE len(words) > 0 GROUP BY 1
),
gaps AS (
  SELECT place, i, array_to_string(list_concat(words[:i - 1], words[i + 1:]), ' ') AS rest
  FROM (SELECT place, words, unnest(range(1, len(words) + 1)) AS i FROM firsts WHERE len(words) >= 5)
),
gone AS (
  SELECT place FROM (SELECT place, min(place) OVER (PARTITION BY i, rest) AS least FROM gaps) WHERE place > least
  UNION
  SELECT greatest(g.place, f.place) FROM gaps g JOIN firsts f ON f.plain = g.rest
),
kept AS (
  SELECT doc_id, pos, line,
         len(words) = 0 OR place IN (SELECT place FROM firsts WHERE place NOT IN (SELECT place FROM gone)) AS stays
  FROM placed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (stays) AS n_kept_lines,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '') AS text
FROM kept GROUP BY doc_id
"""

WARC = """
WITH payloads AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
digests AS (SELECT page_id, url, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM payloads),
newest AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS newest FROM digests)
SELECT page_id, url, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN newest END AS refers_to
FROM newest
"""

JACCARD_JOIN = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, [w FOR w IN regexp_split_to_array(coalesce(text, ''), '\s+') IF w <> ''] AS words FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM worded WHERE len(words) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
),
pairs AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)
),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other),
classes AS (SELECT doc_id, min(other) AS class_id FROM reached GROUP BY doc_id)
SELECT doc_id, class_id, count(l.b) AS n_links FROM classes LEFT JOIN links l ON l.a = doc_id GROUP BY doc_id, class_id
"""

TOPK_SEARCH = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM documents
),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
size AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id),
corpus AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM size) / (SELECT count(*) FROM documents) AS mean),
idf AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS w FROM tf, corpus GROUP BY term),
impact AS (
  SELECT doc_id, term, w * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) AS part
  FROM tf JOIN size USING (doc_id) JOIN idf USING (term), corpus
),
scores AS (
  SELECT q.doc_id AS query_id, d.doc_id, fsum(d.part) AS score
  FROM tf q JOIN impact d ON d.term = q.term WHERE q.doc_id % 20 = 0 GROUP BY 1, 2
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM scores)
SELECT query_id, CAST(place AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM ranked WHERE place <= 10
"""

ORACLES = {
    "op2_line_dedup": LINE_DEDUP,
    "op3_warc": WARC,
    "op4_ngram_jaccard_join": JACCARD_JOIN,
    "op10_topk_search": TOPK_SEARCH,
}

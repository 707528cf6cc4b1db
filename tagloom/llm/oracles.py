"""DuckDB SQL of the operators' results, where SQL can express them."""

from __future__ import annotations

#: Host suffix and path prefix tests in plain SQL; the rules as in ``queries.URL_RULES``.
OP10 = r"""
WITH split AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), rules(r_host, r_path, r_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), best AS (
  SELECT page_id, host, path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM split LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY page_id, host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
"""

#: All pairs of a query and a row.
OP3 = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]), 0) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score
FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""


#: Every document's score for every item, term by term.
OP11 = r"""
WITH t AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), docs AS (
  SELECT d, doc_id, terms, len(terms) AS n, count(*) OVER () AS docs, CAST(sum(len(terms)) OVER () AS BIGINT) AS total FROM t WHERE len(terms) > 0
), tf AS (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf JOIN docs USING (d) GROUP BY term
), q AS (
  SELECT item_id, text, term, count(*) AS times
  FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY ALL
), scored AS (
  SELECT item_id, q.text, doc_id, d, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // total))))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN docs USING (d) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER r AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0 WINDOW r AS (PARTITION BY item_id, text ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER r <= 10
"""


#: CRC-32 byte by byte; near words by their deletions and by letters left open; forms followed by recursion.
OP12 = r"""
WITH RECURSIVE steps AS (
  SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) FOR i IN range(256)] AS crc
), runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), bytes AS (
  SELECT run, n, [4294967295] || flatten([CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END FOR c IN string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, '')]) AS b
  FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c // 256, crc[1 + CAST(xor(c, x) & 255 AS BIGINT)])), 4294967295) AS h FROM bytes, steps
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, any_value(n) AS n, count(*) AS n_near, max(m) AS m, first(near ORDER BY m DESC, near) AS near FROM near GROUP BY word
), forms AS (
  SELECT word, near AS form, m AS form_n FROM best WHERE m >= 10 * n
), chain(word, root) AS (
  SELECT word, form FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word
), roots AS (
  SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM forms)
)
SELECT w.word, form, coalesce(root, w.word) AS root, w.n, coalesce(n_near, 0) AS n_near, form_n
FROM words w LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word) LEFT JOIN roots r USING (word)
"""


#: All pairs of documents that share a shingle; components by the smallest doc_id that links reach.
OP13 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)]) END AS shingles
  FROM w
), one AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach(doc_id, other) AS (
  SELECT a, b FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (
  SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id FROM s LEFT JOIN least USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": OP3, "op10_url_filter": OP10, "op11_block_max": OP11, "op12_spelling_variants": OP12, "op13_jaccard_join": OP13}

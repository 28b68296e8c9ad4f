"""The corpus queries as plain SQL, where SQL can express them on the test tables."""

EXACT_DEDUP = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d"""

# the pages mark their article, and hold only headings, paragraphs, bold type and line ends
HTML_TEXT = r"""
WITH found AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
blocks AS (
  SELECT page_id, url, list_filter(list_transform(string_split_regex(body, '</?(?:p|h1)>'),
    lambda b: trim(regexp_replace(
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        regexp_replace(regexp_replace(b, '</?b>', '', 'g'), '<br>', ' ', 'g'),
        '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'),
      '\s+', ' ', 'g'))), lambda b: b <> '') AS bs
  FROM found)
SELECT page_id, url, array_to_string(bs, chr(10)) AS text, length(array_to_string(bs, chr(10))) AS n_chars
FROM blocks"""


def _lloyd(books: str, out: str) -> str:
    """Assign every part under ``books`` and replace entries by floored means, as ``out``."""
    return f"""
near_{out} AS (
  SELECT vec_id, part, min(d * 64 + e) AS m FROM (
    SELECT p.vec_id, p.part, b.e,
           list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM p JOIN {books} b USING (part)) GROUP BY vec_id, part),
means_{out} AS (
  SELECT part, e, list(floor(s / n)::BIGINT ORDER BY pos) AS c FROM (
    SELECT p.part, m % 64 AS e, t.pos, sum(p.x[t.pos])::DOUBLE AS s, count(*)::DOUBLE AS n
    FROM p JOIN near_{out} USING (vec_id, part), (SELECT unnest(range(1, 5)) AS pos) t
    GROUP BY ALL) GROUP BY part, e),
{out} AS (
  SELECT b.part, b.e, coalesce(n.c, b.c) AS c FROM {books} b LEFT JOIN means_{out} n USING (part, e))"""


CODE_VECTORS = f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT vec_id, part, v[part * 4 + 1 : part * 4 + 4] AS x FROM k, (SELECT unnest(range(16)) AS part)),
b0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c
  FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)),
{_lloyd("b0", "b1")},
{_lloyd("b1", "b2")},
{_lloyd("b2", "b3")},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', (m % 64)::INTEGER), '' ORDER BY part) AS code,
         sum(m // 64)::BIGINT AS error
  FROM near_b3 GROUP BY vec_id),
books AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::VARCHAR), ','), ',' ORDER BY part, e)) AS h
  FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       h AS codebooks_sha256
FROM coded JOIN k USING (vec_id), books"""

PREFIX_TRIE = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
seqs AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, role, text) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
  SELECT conv_id, own,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''),
           lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM seqs, crc),
rebuilt AS (
  SELECT c.conv_id, list_concat(CASE WHEN c.h = 0 OR b.own IS NULL THEN [] ELSE b.own[1 : c.h] END,
                                c.own[c.h + 1 : len(c.own)]) AS s
  FROM heads c LEFT JOIN seqs b ON b.conv_id = c.conv_id - c.conv_id % 20),
steps AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM rebuilt),
members AS (
  SELECT conv_id, d, CASE WHEN d = 0 THEN [] ELSE s[1 : d] END AS prefix, len(s) = d AS ends FROM steps),
nodes AS (
  SELECT prefix, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY prefix),
up AS (
  SELECT n.*, CASE WHEN d > 0 THEN CASE WHEN d = 1 THEN [] ELSE prefix[1 : d - 1] END END AS above,
         CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) *
           len(regexp_extract_all(prefix[d].t, '[^\x20\x09-\x0D]+')) END AS saved
  FROM nodes n),
families AS (SELECT above AS prefix, count(*) AS n_children FROM up WHERE d > 0 GROUP BY above),
whole AS (SELECT u.*, coalesce(f.n_children, 0) AS n_children FROM up u LEFT JOIN families f USING (prefix)),
totals AS (
  SELECT a.prefix, sum((b.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens
  FROM whole a JOIN whole b
    ON b.d >= a.d AND CASE WHEN a.d = 0 THEN true ELSE b.prefix[1 : a.d] = a.prefix END
  GROUP BY a.prefix)
SELECT w.conv_id, w.d::BIGINT AS depth, o.conv_id AS parent_conv_id, w.n_convs, w.n_children,
       t.n_leaves, t.saved_tokens, w.ends_sha256
FROM whole w JOIN totals t USING (prefix) LEFT JOIN nodes o ON o.prefix = w.above"""

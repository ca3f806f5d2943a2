"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

# Base32 digits of a 160-bit hex digest: 4 digits for each group of 5 hex digits.
_BASE32 = "||".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((g{g} // {32 ** (3 - k)}) % 32), 1)" for g in range(8) for k in range(4))
_GROUPS = ", ".join(
    "(" + " + ".join(f"(instr('0123456789abcdef', substr(hex, {5 * g + k + 1}, 1)) - 1) * {16 ** (4 - k)}" for k in range(5)) + f") AS g{g}"
    for g in range(8))

SQL: dict[str, str] = {}

SQL["op4_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS g
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
line AS (SELECT doc_id, source, t, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
                trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
         FROM (SELECT doc_id, source, t, unnest(l) AS x FROM d)),
per AS (SELECT source, doc_id, t, h, sum(n) AS n FROM line GROUP BY ALL),
bad AS (SELECT source, h, arg_min(t, doc_id) AS keeper FROM per GROUP BY source, h HAVING count(DISTINCT t) > 20),
gone AS (SELECT doc_id, sum(n) AS n FROM per JOIN bad USING (h) WHERE per.source IS NOT DISTINCT FROM bad.source AND t <> keeper GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(array_to_string(w, '')), 0) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_line_words
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT ((n_words - n_line_words) * 100 < n_words * 30) AS kept, n_line_words::BIGINT AS n_line_words
FROM f
"""

SQL["op5_warc"] = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last, {_GROUPS} FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM g
"""

SQL["op8_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

SQL["op2_ngram_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) > 2)
  UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT reach.u, pair.v FROM reach JOIN pair ON reach.v = pair.u),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""

SQL["op2_ngram_links"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) > 2)
  UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*)))
SELECT d.doc_id, count(pair.v)::BIGINT AS n_links FROM d LEFT JOIN pair ON pair.u = d.doc_id GROUP BY d.doc_id
"""

SQL["op10_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM late, (SELECT unnest(generate_series(0, 19)) AS k)),
word AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

SQL["op7_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM win) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM late, (SELECT unnest(range(0, 50)) AS k)),
span AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE p IS NULL OR p < i - 1) AS s
         FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM gone) GROUP BY doc_id),
byte AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM d JOIN span USING (doc_id))),
kept AS (SELECT doc_id, string_agg(x, '' ORDER BY i) AS k FROM byte ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(span.n, 0)::BIGINT AS n_removed, coalesce(span.s, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN span.n IS NULL THEN h ELSE coalesce(k, '') END)) AS kept_sha256
FROM d LEFT JOIN span USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SQL["op12_fill_middle"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
h AS (
  SELECT doc_id, t, n, ('0x' || substr(hex, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(hex, 9, 8))::BIGINT % (n + 1) AS b,
         ('0x' || substr(hex, 17, 8))::BIGINT % 100 AS x, ('0x' || substr(hex, 25, 8))::BIGINT % 100 AS y FROM d),
f AS (
  SELECT doc_id, t, n, least(a, b) AS lo, greatest(a, b) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x >= 90 THEN 'plain'
              WHEN y < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, lo) AS prefix, substr(t, lo + 1, hi - lo) AS middle, substr(t, hi + 1) AS suffix FROM f)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN lo::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (hi - lo)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

SQL["op13_lexical_search"] = r"""
WITH dt AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
dn AS (SELECT row_number() OVER () AS r, doc_id, w AS words, len(w) AS n FROM dt WHERE len(w) > 0),
c AS (SELECT count(*)::HUGEINT AS nd, sum(n)::HUGEINT AS nl FROM dn),
tf AS (SELECT r, t, count(*)::HUGEINT AS tf FROM (SELECT r, unnest(words) AS t FROM dn) GROUP BY r, t),
wt AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::HUGEINT AS w FROM tf, c GROUP BY t, nd),
q AS (SELECT item_id, t, count(*)::HUGEINT AS k FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t),
s AS (
  SELECT item_id, dn.r, dn.doc_id,
         sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nl)))) AS score
  FROM q JOIN wt USING (t) JOIN tf USING (t) JOIN dn USING (r), c GROUP BY item_id, dn.r, dn.doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score::BIGINT AS score FROM o WHERE rank <= 20
"""

"""SQL for the numbered queries that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op2_quality_rules"] = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY r),
m AS (
  SELECT r, doc_id, source, len(w) AS n_words,
         coalesce(CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words, len(l) AS n_lines
  FROM t LEFT JOIN hit USING (r)),
f AS (
  SELECT *, n_words < 10 AS short, n_repeat_words * 100 > n_words * 20 AS repetitive, n_symbols * 10 > n_words AS symbols,
         n_dup_lines * 10 > n_lines * 3 AS duplicate_lines,
         word_chars < n_words * 2 OR word_chars > n_words * 20 AS word_length
  FROM m),
s AS (
  SELECT source, count(*) AS n, count_if(short) AS a, count_if(repetitive) AS b, count_if(symbols) AS c,
         count_if(duplicate_lines) AS d, count_if(word_length) AS e
  FROM f WHERE source IS NOT NULL GROUP BY source),
u AS (
  SELECT source, n, 1 AS rule, a AS fails FROM s UNION ALL SELECT source, n, 2, b FROM s
  UNION ALL SELECT source, n, 3, c FROM s UNION ALL SELECT source, n, 4, d FROM s
  UNION ALL SELECT source, n, 5, e FROM s),
p AS (
  SELECT rule, m, CASE WHEN v > 0 THEN greatest(1, least(1000, m * (1 - m) / v - 1)) ELSE 1000 END AS k
  FROM (SELECT rule, avg(fails / n) AS m, coalesce(var_samp(fails / n), 0) AS v FROM u GROUP BY rule)),
bad AS (
  SELECT source FROM u JOIN p USING (rule) GROUP BY source HAVING max((fails + m * k) / (n + k)) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed,
       NOT (short OR repetitive) AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM f
"""

SQL["op1_line_dedup"] = r"""
WITH l AS (
  SELECT r, doc_id, i, s[i] AS line,
         translate(regexp_replace(regexp_replace(s[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, s, unnest(range(1, len(s) + 1)) AS i
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
bad AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3)
SELECT doc_id, count(*) AS n_lines, count(bad.k) FILTER (WHERE bad.last <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE bad.k IS NULL OR bad.last = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN bad USING (k) GROUP BY r, doc_id
"""

SQL["op6_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17') AS o
  FROM documents),
s AS (
  SELECT source, n, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source)),
f AS (
  SELECT *, 1.5::DOUBLE * sum(n) OVER () - coalesce(sum(2 * n) OVER b, 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS weight, row_number() OVER (ORDER BY 2 * n / w, source NULLS LAST) AS k
  FROM s WINDOW b AS (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT min(k) AS k FROM f WHERE w * rest / weight <= 2 * n),
t AS (
  SELECT source, n, CASE WHEN f.k < c.k THEN 2.0::DOUBLE * n
         ELSE w * (SELECT g.rest / g.weight FROM f AS g, c AS h WHERE g.k = h.k) END AS target
  FROM f, c),
p AS (
  SELECT d.*, n, target, CAST(round_even(target, 0) AS BIGINT) AS q,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n AS source_size, target,
       CAST(CASE WHEN n = 0 THEN 0 ELSE q // n * size + greatest(0, least(size, q % n - before)) END AS BIGINT) AS taken
FROM p
"""

SQL["op5_decontamination"] = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
c AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
m AS (SELECT r, i, n, item_id FROM c JOIN g USING (n, g)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
k AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r)
"""

SQL["op10_url_filters"] = r"""
WITH u AS (
  SELECT row_number() OVER () AS r, page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         string_split(repeat(chr(10), 5) || translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS s
  FROM pages),
rules(v, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
x AS (
  SELECT u.*, rule, v, instr('13579bdf', right(md5(url), 1)) > 0 AS odd,
         list_transform(range(1, len(s) - 4), lambda i: array_to_string(s[i:i + 5], '')) AS grams
  FROM u LEFT JOIN m USING (r)),
e AS (SELECT r, unnest(grams) AS g, coalesce(v = 'allow' AND NOT odd, false) AS a, coalesce(v = 'block' AND NOT odd, false) AS b FROM x),
d5 AS (SELECT g, count_if(a) AS na, count_if(b) AS nr FROM e GROUP BY g),
""" + "".join(f"""
d{k} AS (SELECT right(g, {k + 1}) AS g, CAST(sum(na) AS BIGINT) AS na, CAST(sum(nr) AS BIGINT) AS nr FROM d{k + 1} GROUP BY 1),""" for k in range(4, -1, -1)) + """
p AS (SELECT 1::DOUBLE / 1114112 AS even),
p0 AS (
  SELECT g, CASE WHEN ma = 0 THEN even ELSE (na + ta * even) / (ma + ta) END AS pa,
         CASE WHEN mr = 0 THEN even ELSE (nr + tr * even) / (mr + tr) END AS pr
  FROM d0, p, (SELECT sum(na) AS ma, count_if(na > 0) AS ta, sum(nr) AS mr, count_if(nr > 0) AS tr FROM d0)),
""" + "".join(f"""
p{k} AS (
  SELECT d.g, CASE WHEN ma = 0 THEN pa ELSE (na + ta * pa) / (ma + ta) END AS pa,
         CASE WHEN mr = 0 THEN pr ELSE (nr + tr * pr) / (mr + tr) END AS pr
  FROM d{k} AS d
  JOIN (SELECT left(g, {k}) AS ctx, sum(na) AS ma, count_if(na > 0) AS ta, sum(nr) AS mr, count_if(nr > 0) AS tr
        FROM d{k} GROUP BY 1) ON ctx = left(d.g, {k})
  JOIN p{k - 1} AS q ON q.g = substr(d.g, 2)),""" for k in range(1, 6)) + r"""
sums AS (
  SELECT r, sum(ratio) AS total, count(*) AS n
  FROM e JOIN (SELECT g, CAST(round((ln(pa) - ln(pr)) * 1000000) AS BIGINT) AS ratio FROM p5) USING (g) GROUP BY r),
scored AS (
  SELECT page_id, host, path, rule, v, odd, coalesce(CAST(trunc(total / n) AS BIGINT), 0) AS score
  FROM x LEFT JOIN sums USING (r)),
bins AS (
  SELECT CAST(floor(score / 10000.0::DOUBLE) AS BIGINT) AS bin, count_if(v = 'allow') AS good, count_if(v = 'block') AS bad
  FROM scored WHERE v IS NOT NULL AND odd GROUP BY 1),
edges AS (
  SELECT bin, bin + low AS twice, (tg - gb)::DOUBLE / tg + bb::DOUBLE / tb AS gain
  FROM (SELECT bin, coalesce(lag(bin) OVER (ORDER BY bin) + 1, bin) AS low, sum(good) OVER () AS tg, sum(bad) OVER () AS tb,
               coalesce(sum(good) OVER w, 0) AS gb, coalesce(sum(bad) OVER w, 0) AS bb
        FROM bins WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE tg > 0 AND tb > 0),
cut AS (
  SELECT coalesce((SELECT b[(len(b) - 1) // 2 + 1] * 5000 FROM (
    SELECT list(twice ORDER BY bin) AS b FROM edges WHERE gain = (SELECT max(gain) FROM edges))), 0) AS cut)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict
FROM scored, cut
"""

SQL["op11_hard_negatives"] = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a, v.vec_id AS b, a.label = v.label AS same, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS s
  FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT a, b AS positive, s AS ps FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT a AS anchor_id, positive AS positive_id,
       CAST(row_number() OVER (PARTITION BY a, positive ORDER BY s DESC, b) AS INT) AS rank,
       b AS negative_id, ps AS positive_score, s AS negative_score
FROM p JOIN s USING (a) WHERE NOT same AND 50 * ps <= 100 * s AND 100 * s <= 95 * ps
QUALIFY row_number() OVER (PARTITION BY a, positive ORDER BY s DESC, b) <= 3
"""

# DuckDB has no crc32: each byte is folded in by eight shifts.
SQL["op12_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id AS c, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations),
o AS (SELECT c, list(x ORDER BY i) AS w FROM t GROUP BY c),
h AS (
  SELECT c, w, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
             string_split(CAST(c AS VARCHAR), ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda crc, b: CASE WHEN b >= 0 THEN xor(crc, b) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END),
         4294967295) % 6 AS h
  FROM o),
r AS (
  SELECT h.c, list_concat(coalesce(o.w[1:h.h], []), h.w[h.h + 1:]) AS w
  FROM h LEFT JOIN o ON o.c = h.c - h.c % 100),
p AS (SELECT c, len(w) AS m, d, w[1:d] AS key, w[1:d - 1] AS up FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM r)),
n AS (
  SELECT d, key, any_value(up) AS up, min(c) AS c, count(*) AS n,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE m = d), '')) AS ends
  FROM p GROUP BY d, key),
k AS (
  SELECT n.*, coalesce(q.k, 0) AS k
  FROM n LEFT JOIN (SELECT d - 1 AS d, up AS key, count(*) AS k FROM n WHERE d > 0 GROUP BY ALL) AS q USING (d, key)),
b AS (
  SELECT x.d, x.key, CAST(count(*) FILTER (WHERE k.k = 0) AS BIGINT) AS leaves,
         CAST(sum(CASE WHEN k.d = 0 THEN 0 ELSE (k.n - 1) * length(k.key[-1]['text']) END) AS BIGINT) AS saved
  FROM k, (SELECT unnest(range(0, k.d + 1)) AS d, k.key[1:unnest(range(0, k.d + 1))] AS key) AS x
  GROUP BY x.d, x.key)
SELECT k.c AS conv_id, k.d AS depth, u.c AS parent_conv_id, k.n AS n_convs, k.k AS n_children, leaves AS n_leaves,
       saved AS saved_tokens, k.ends AS ends_sha256
FROM k JOIN b USING (d, key) LEFT JOIN n AS u ON u.d = k.d - 1 AND u.key = k.up
"""

SQL["op13_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, r) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

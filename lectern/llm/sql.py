"""SQL that gives the rows of operators which it can express, for small tables."""

OP2_SQL = """
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS l FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(l) - 48)) AS i FROM w WHERE len(l) >= 50),
g AS (SELECT p.doc_id, i, sha256(array_to_string(l[i:i + 49], ' ')) AS s FROM p JOIN w USING (doc_id)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM g JOIN f USING (s) WHERE first < doc_id),
u AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM w),
k AS (SELECT u.doc_id, count(*) AS kept, string_agg(x, ' ' ORDER BY u.k) AS t FROM u LEFT JOIN r ON u.doc_id = r.doc_id AND u.k = r.k WHERE r.k IS NULL GROUP BY u.doc_id)
SELECT w.doc_id, len(l) AS n_words, len(l) - coalesce(kept, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

OP6_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS l FROM documents),
s AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
  ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS x FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, w.doc_id = r.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""

OP9_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS i FROM t WHERE length(h) >= 200),
g AS (SELECT p.doc_id, i, md5(substring(h, 2 * i + 1, 200)) AS s FROM p JOIN t USING (doc_id)),
f AS (SELECT s, min((doc_id, i)) AS first FROM g GROUP BY s HAVING count(*) > 1),
d AS (SELECT doc_id, i, i + 100 AS e FROM g JOIN f USING (s) WHERE (doc_id, i) <> first),
m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d),
q AS (SELECT *, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM m),
r AS (SELECT doc_id, span, min(i) AS lo, max(e) AS hi FROM q GROUP BY doc_id, span),
o AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM r),
k AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo)::BIGINT AS n_removed, max(hi) AS last, string_agg(substring(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head FROM o JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head || substring(h, 2 * last + 1), h))) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)
"""

#: The checksum is folded byte by byte through a table that the rule of its polynomial makes.
OP13_SQL = """
WITH RECURSIVE tab AS (SELECT range AS i, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM tab WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS l FROM tab WHERE k = 8),
h AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, l[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, t),
g AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 % 8 AS e FROM h),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + e)) + 1] END) END AS w FROM g),
u AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM d),
m AS (SELECT a.doc_id, b.i - a.i AS p, a.i - row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS s, a.i AS i
  FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
z AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM m GROUP BY doc_id, p, s HAVING count(*) + p >= greatest(6, 4 * p)),
r AS (SELECT doc_id, start, length, min(p) AS period FROM z GROUP BY doc_id, start, length),
o AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY u.i) AS t FROM u LEFT JOIN o ON u.doc_id = o.doc_id AND u.i = o.i WHERE o.i IS NULL GROUP BY u.doc_id),
s AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM r GROUP BY doc_id),
f AS (SELECT a.* FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE a.doc_id = b.doc_id AND (b.length * a.period > a.length * b.period OR b.length * a.period = a.length * b.period AND (b.start, b.period) < (a.start, a.period))))
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, f.start, f.length, f.period, 1000 * f.length // f.period AS exponent_milli, sha256(coalesce(s.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN k USING (doc_id)
"""

OP12_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 30),
x AS (SELECT lang, k, phrase, f AS a, w, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT x.lang, x.phrase, a, (2000000::HUGEINT * a // (l.f::HUGEINT + r.f))::BIGINT AS score, cut, l.f AS l, r.f AS r FROM x
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
h AS (SELECT lang, array_to_string(w[i:i + z - 1], ' ') AS phrase, max(f) AS held FROM (SELECT lang, w, f, k, z, unnest(range(1, k - z + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS z FROM c)) GROUP BY ALL),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score FROM b LEFT JOIN h USING (lang, phrase) WHERE held IS NULL OR 100::HUGEINT * held < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""

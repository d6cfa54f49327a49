"""DuckDB SQL of the corpus queries that SQL can express, by plain definitions over whole tables."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array({text}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"

OP2 = """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM good q JOIN good c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs QUALIFY rank <= 5
"""

OP3 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, text IS NULL AS missing FROM documents),
l AS (SELECT doc_id, pos, lines, len({_WORDS.format(text="lines[pos]")}) AS words FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS pos FROM d WHERE NOT missing)),
t AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l),
ahead AS (SELECT a.doc_id, a.pos AS first, min(b.pos) AS last FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - (a.upto - a.words) >= 50 GROUP BY ALL),
back AS (SELECT a.doc_id, max(b.pos) AS first, a.pos AS last FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos <= a.pos AND a.upto - (b.upto - b.words) >= 50 GROUP BY ALL),
w AS (SELECT DISTINCT * FROM (SELECT doc_id, first, last FROM ahead UNION ALL SELECT doc_id, first, last FROM back)),
named AS (SELECT w.*, array_to_string(lines[first:last], chr(10)) AS content, last - first AS n FROM w JOIN d USING (doc_id)),
late AS (SELECT doc_id, first, last FROM named QUALIFY row_number() OVER (PARTITION BY content, n ORDER BY doc_id, first) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM late),
cut AS (SELECT doc_id, list(pos) AS g FROM gone GROUP BY ALL)
SELECT doc_id, CAST(CASE WHEN missing THEN 0 ELSE len(lines) END AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: g IS NULL OR NOT list_contains(g, i)), lambda i: lines[i]), chr(10)), '')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS content FROM (SELECT *, unnest(range(1, len(words) - 18)) AS i FROM d WHERE len(words) >= 20)),
late AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, i) > 1),
cut AS (SELECT doc_id, list(pos) AS g FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM late) GROUP BY ALL)
SELECT doc_id, len(words) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda i: g IS NULL OR NOT list_contains(g, i)), lambda i: words[i]), ' '), '')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY ALL),
both_in AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM both_in JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.size + q.size - shared)),
reach AS (SELECT doc_id, doc_id AS seen FROM d UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.seen = l.x)
SELECT d.doc_id, coalesce(max(size), 0) AS n_shingles, min(seen) AS component_id, d.doc_id = min(seen) AS kept FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""

#: crc32 over a table of 256 remainders, a byte at a time.
OP11 = """
WITH RECURSIVE bits AS (SELECT b, b AS c, 0 AS k FROM range(256) t(b) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
remainders AS (SELECT list(c ORDER BY b) AS r FROM bits WHERE k = 8),
found AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS times, hex(encode(concat(doc_id, ':', run))) AS h FROM found GROUP BY ALL),
hashed AS (SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)), lambda c, b: xor(c // 256, r[xor(c % 256, b) + 1]))) AS crc FROM runs, remainders),
words AS (SELECT CASE WHEN crc % 199 = 0 THEN run[:crc % length(run)] || run[crc % length(run) + 2:] ELSE run END AS word, times FROM hashed),
w AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY ALL HAVING sum(times) >= 5),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w),
holes AS (SELECT word, i, word[:i - 1] || '*' || word[i + 1:] AS h, word[:i - 1] || word[i + 1:] AS d FROM places),
pairs AS (SELECT x.word, y.word AS other FROM holes x JOIN holes y ON x.h = y.h AND x.i = y.i AND x.word <> y.word UNION SELECT holes.word, d FROM holes JOIN w v ON v.word = d UNION SELECT d, holes.word FROM holes JOIN w v ON v.word = d),
near AS (SELECT p.word, count(*) AS n_near, arg_min(p.other, struct_pack(a := -o.n, b := p.other)) AS top, max(o.n) AS top_n FROM pairs p JOIN w o ON o.word = p.other GROUP BY ALL),
forms AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * n THEN top END AS form, CASE WHEN top_n >= 5 * n THEN top_n END AS form_n FROM w LEFT JOIN near USING (word)),
steps AS (SELECT word, word AS root, 0 AS k FROM w UNION ALL SELECT s.word, f.form, k + 1 FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL)
SELECT f.word, form, arg_max(root, k) AS root, n, n_near, form_n FROM forms f JOIN steps s ON s.word = f.word GROUP BY ALL
"""

OP12 = """
WITH RECURSIVE good AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id, vec_id AS seen FROM embeddings UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON r.seen = l.x),
counts AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY ALL)
SELECT e.vec_id, coalesce(n, 0) AS n_links, min(seen) AS component_id, e.vec_id = min(seen) AS kept FROM embeddings e JOIN reach USING (vec_id) LEFT JOIN counts USING (vec_id) GROUP BY e.vec_id, n
"""

ORACLE_SQL = {"op2_topk": OP2, "op3_line_dedup": OP3, "op5_substring_dedup": OP5, "op10_minhash": OP10, "op11_spelling": OP11, "op12_embedding_dedup": OP12}

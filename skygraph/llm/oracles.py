"""DuckDB SQL with the rows of the queries that SQL can express: by brute force over all pairs or places."""

from __future__ import annotations

OP3 = """WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT links.a, reach.r FROM reach JOIN links ON links.b = reach.vec_id),
least AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept, CASE WHEN (SELECT count(*) FROM n WHERE vec_id % 50 = 0) > 0 THEN 1E0 END AS recall FROM embeddings JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)"""

OP4 = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS words FROM documents),
class AS (SELECT words, min(doc_id) AS rep, count(*) AS n_copies FROM w WHERE len(words) > 0 GROUP BY words),
s AS (SELECT rep, unnest(list_transform(range(1, greatest(len(words) - 3, 2)), lambda i: array_to_string(words[i:i + 4], ' '))) AS g FROM class),
m AS (SELECT rep, g, count(*) AS n FROM s GROUP BY rep, g), size AS (SELECT rep, sum(n) AS n FROM m GROUP BY rep),
common AS (SELECT a.rep AS a, b.rep AS b, sum(least(a.n, b.n)) AS c FROM m a JOIN m b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep),
links AS (SELECT a, b FROM common JOIN size x ON x.rep = a JOIN size y ON y.rep = b WHERE c / (x.n + y.n - c) >= 0.8),
reach AS (SELECT rep, rep AS r FROM class UNION SELECT links.a, reach.r FROM reach JOIN links ON links.b = reach.rep),
least AS (SELECT rep, min(r) AS component FROM reach GROUP BY rep),
told AS (SELECT w.doc_id, component, n_copies FROM w JOIN class USING (words) JOIN least USING (rep))
SELECT doc_id, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept, coalesce(n_copies, 1) AS n_copies FROM w LEFT JOIN told USING (doc_id)"""

# parts of runs: from each line the fewest lines with ten words, and up to each line likewise
OP9 = """WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d),
w AS (SELECT doc_id, pos, CASE WHEN line = '' THEN 0 ELSE length(line) - length(replace(line, ' ', '')) + 1 END AS words FROM l),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM w),
pairs AS (SELECT a.doc_id, a.pos AS s, b.pos AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.pos <= b.pos WHERE b.upto - a.upto + a.words >= 10),
parts AS (SELECT doc_id, s, min(e) AS e FROM pairs GROUP BY doc_id, s UNION SELECT doc_id, max(s), e FROM pairs GROUP BY doc_id, e),
told AS (SELECT parts.*, array_to_string(ls[s + 1:e + 1], chr(10)) AS content FROM parts JOIN d USING (doc_id)),
again AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS nth FROM told) WHERE nth > 1),
gone AS (SELECT doc_id, list_sort(list_distinct(list(pos))) AS removed FROM (SELECT doc_id, unnest(range(s, e + 1)) AS pos FROM again) GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(len(ls), 0) AS INT) AS n_lines, CAST(coalesce(len(removed), 0) AS INT) AS n_removed, coalesce(array_to_string(removed, ','), '') AS removed,
  CASE WHEN removed IS NULL THEN documents.text ELSE array_to_string(list_transform(list_filter(range(len(ls)), lambda i: NOT list_contains(removed, i)), lambda i: ls[i + 1]), chr(10)) END AS text
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN gone USING (doc_id)"""



def _nearest(step: int) -> str:
    """Each vector's centroid of a step, the smaller number of equals, and its squared distance."""
    d = "CAST(list_sum(list_transform(range(1, 65), lambda i: (k.q[i] - c.q[i]) * (k.q[i] - c.q[i]))) AS BIGINT)"
    return f"a{step} AS (SELECT rid, arg_min(c, [d, c]) AS c, min(d) AS d FROM (SELECT rid, c.c AS c, {d} AS d FROM k, c{step} c) GROUP BY rid)"


def _moved(step: int) -> str:
    """Floors of the means; an empty cluster keeps its centroid."""
    mean = "(s - ((s % n) + n) % n) // n"
    return f"""m{step} AS (SELECT c, list(CAST({mean} AS BIGINT) ORDER BY i) AS q FROM (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.c AS c, unnest(k.q) AS x, unnest(range(64)) AS i FROM k JOIN a{step} a USING (rid)) GROUP BY c, i) GROUP BY c),
c{step + 1} AS (SELECT c.c AS c, coalesce(m.q, c.q) AS q FROM c{step} c LEFT JOIN m{step} m USING (c))"""


OP11 = f"""WITH k AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64E0 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, q FROM k ORDER BY sha256('1:' || vec_id) LIMIT 16),
{", ".join(f"{_nearest(i)}, {_moved(i)}" for i in range(3))}, {_nearest(3)}
SELECT vec_id, CAST(a.c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM k JOIN a3 a USING (rid) JOIN c3 c USING (c)"""

OP13 = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || doc_id) AS h FROM documents),
k AS (SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM k),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:n], '') AS post FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || post || '<M>' || mid ELSE '<S>' || post || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

ORACLES = {"op3_embedding_dedup": OP3, "op4_minhash": OP4, "op9_line_dedup": OP9, "op11_hamerly": OP11, "op13_fim": OP13}

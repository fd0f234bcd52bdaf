"""SQL of the corpus queries that SQL can express whole."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
m AS (SELECT node, min(root) AS root FROM r GROUP BY 1),
k AS (SELECT a, count(*) AS links FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id, coalesce(links, 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = d.doc_id LEFT JOIN k ON k.a = d.doc_id"""

_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8 = rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS width FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, width, array_to_string(w[i : i + width - 1], ' ') AS s FROM (SELECT *, unnest(generate_series(1, len(w) - width + 1)) AS i FROM b)),
dw AS (SELECT doc_id, width, i, array_to_string(w[i : i + width - 1], ' ') AS s FROM (SELECT doc_id, w, width, unnest(generate_series(1, len(w) - width + 1)) AS i FROM d, (SELECT DISTINCT width FROM b) WHERE len(w) >= width)),
h AS (SELECT doc_id, i, dw.width, item_id FROM dw JOIN bw ON bw.s = dw.s AND bw.width = dw.width),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + width - 1)) AS k FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP13 = f"""WITH d AS (SELECT doc_id, sha256({_LOW}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256 FROM d WINDOW w AS (PARTITION BY text_sha256)"""


def _op11(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """Each round: distances of all parts to their codebook's entries, the least (ties by entry), floored means."""
    floor_mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    sql = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, x[part * w + 1 : part * w + w] AS v FROM (SELECT *, CAST(len(x) // {parts} AS BIGINT) AS w FROM k), (SELECT unnest(range({parts})) AS part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v AS c FROM p WHERE r <= {entries})"""
    nearest = "SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT r, p.part, entry, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{i} USING (part)) GROUP BY 1, 2"
    for i in range(rounds):
        sql += f""",
a{i} AS MATERIALIZED ({nearest.format(i=i)}),
m{i} AS (SELECT part, entry, list(m ORDER BY j) AS c FROM (SELECT part, entry, j, {floor_mean} AS m FROM (SELECT part, entry, j, sum(v[j]) AS s, count(*) AS n FROM a{i} JOIN p USING (r, part), unnest(range(1, len(v) + 1)) AS t(j) GROUP BY 1, 2, 3)) GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (part, entry))"""
    return sql + f""",
f AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM ({nearest.format(i=rounds)}) GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256 FROM f JOIN k USING (r)"""


OP11 = _op11()

#: CRC-32 of the UTF-8 bytes of column f: the table by its rule (polynomial EDB88320, reflected), then byte by byte.
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, i) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i))"
_CRC = "xor(list_reduce(list_transform(range(1, octet_length(encode(f)) + 1), lambda i: CAST(('0x' || substring(hex(encode(f)), 2 * i - 1, 2)) AS BIGINT)), lambda x, b: xor(x // 256, t[xor(x, b) % 256 + 1]), 4294967295), 4294967295)"

OP12 = f"""WITH {_CRC_TABLE},
d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
df AS MATERIALIZED (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(w, list_transform(list_zip(w[1:-2], w[2:]), lambda p: p[1] || ' ' || p[2]))) AS f FROM d) GROUP BY 1, 2),
bf AS MATERIALIZED (SELECT f, count(*) AS n FROM (SELECT unnest(list_concat(w, list_transform(list_zip(w[1:-2], w[2:]), lambda p: p[1] || ' ' || p[2]))) AS f FROM b) GROUP BY 1),
k AS MATERIALIZED (SELECT f, {_CRC} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), crc),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN k USING (f) GROUP BY 1), t AS (SELECT bucket, sum(n) AS t FROM bf JOIN k USING (f) GROUP BY 1),
g AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM df) + 10000) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM bf) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
m AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY 1),
e AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
  CAST('0x' || substring(sha256('7:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM e),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM o) THEN rank END AS rank FROM r LEFT JOIN o USING (doc_id)"""

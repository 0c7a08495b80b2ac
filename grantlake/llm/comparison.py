"""Comparison SQL (DuckDB) for the queries whose whole result SQL can express."""

WORDS = r"""d AS (SELECT doc_id, coalesce(regexp_extract_all({text}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents)"""

PRODUCTS = """
WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST("rank" AS INTEGER) AS "rank", vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS "rank" FROM p) WHERE "rank" <= 20"""

NEAR_DUPLICATES = (
    "WITH RECURSIVE "
    + WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """,
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM reached r JOIN edges e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, d.doc_id = min(c) AS kept
FROM d JOIN reached r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""
)

PASSAGES = (
    "WITH "
    + WORDS.format(text="text")
    + """,
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
low AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
hit AS (SELECT doc_id, i FROM win JOIN low USING (h) WHERE lo < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 50)) AS k FROM hit)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""
)

CHAT = r"""
WITH raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]')) + 4 AS tokens,
    9 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')) + length(regexp_replace(role, '[^\]]', '', 'g')) AS shown FROM raw),
u AS (SELECT *, max(CASE WHEN k = 1 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id) AS sys,
    max(CASE WHEN k = 1 AND role = 'system' THEN shown END) OVER (PARTITION BY conv_id) AS sys_shown,
    sum(tokens) OVER (PARTITION BY conv_id ORDER BY k) AS upto,
    lag(tokens, 1) OVER (PARTITION BY conv_id ORDER BY k) AS t1, lag(tokens, 2) OVER (PARTITION BY conv_id ORDER BY k) AS t2,
    lag(shown, 1) OVER (PARTITION BY conv_id ORDER BY k) AS s1, lag(shown, 2) OVER (PARTITION BY conv_id ORDER BY k) AS s2 FROM t),
c AS (SELECT *, greatest(384 - coalesce(sys, 0), 1) AS room FROM u),
b AS (SELECT *, floor((upto - tokens) / room) AS lo, floor((upto - 1) / room) AS hi FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, CASE WHEN lo = hi THEN 2 * hi ELSE 2 * hi - 1 END ORDER BY k) AS place FROM b),
x AS (SELECT *, k > 1 AND t1 <= 128 AND NOT (sys IS NOT NULL AND k = 2) AS one, k > 2 AND t1 <= 128 AND t1 + t2 <= 128 AND NOT (sys IS NOT NULL AND k <= 3) AS two FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(shown + CASE WHEN place = 1 THEN CASE WHEN sys IS NOT NULL AND k > 1 THEN sys_shown ELSE 0 END + CASE WHEN one THEN s1 ELSE 0 END + CASE WHEN two THEN s2 ELSE 0 END ELSE 0 END) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id"""


def codes(rounds: int = 6) -> str:
    """Product codes: ``rounds`` of nearest entries and means, one pair of CTEs each."""
    nearest = """n{k} AS MATERIALIZED (SELECT p.row, p.vec_id, p.label, p.part, p.v, list_min([struct_pack(d := list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p.v, c.v)]), e := c.entry) FOR c IN b.entries]) AS best
  FROM p JOIN b{k} b USING (part))"""
    means = """m{k} AS (SELECT part, entry, list(x ORDER BY place) AS v FROM (
  SELECT part, best.e AS entry, place, CAST(floor(sum(v[place]) / count(*)) AS BIGINT) AS x FROM n{k}, unnest(range(1, len(v) + 1)) AS u(place) GROUP BY ALL) GROUP BY ALL),
b{next} AS MATERIALIZED (SELECT part, list(struct_pack(entry := entry, v := coalesce(m.v, o.v)) ORDER BY entry) AS entries
  FROM (SELECT part, unnest(entries, recursive := true) FROM b{k}) o LEFT JOIN m{k} m USING (part, entry) GROUP BY part)"""
    steps = [nearest.format(k=0)]
    for k in range(rounds):
        steps += [means.format(k=k, next=k + 1), nearest.format(k=k + 1)]
    return """
WITH kept AS (SELECT row_number() OVER () AS row, vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
p AS MATERIALIZED (SELECT row, vec_id, label, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS v FROM kept, unnest(range(8)) AS u(part)),
b0 AS MATERIALIZED (SELECT part, list(struct_pack(entry := entry, v := v) ORDER BY entry) AS entries FROM (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p QUALIFY entry < 16) GROUP BY part),
""" + ",\n".join(steps) + """,
book AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) AS digest FROM (
  SELECT part, c.entry AS entry, place, c.v[place] AS x FROM (SELECT part, unnest(entries) AS c FROM b{last}), unnest(range(1, len(c.v) + 1)) AS u(place))),
coded AS (SELECT row, vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM n{last} GROUP BY row, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM coded, book""".format(last=rounds)


CODES = codes()

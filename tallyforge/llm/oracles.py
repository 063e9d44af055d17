"""DuckDB SQL for the operators of this subpackage that SQL can express; the others are tested by brute force."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_WHITE_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
win AS (
  SELECT item_id, least(13, len(w)) AS size, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda p: array_to_string(w[p : p + least(13, len(w)) - 1], ' '))) AS text
  FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
runs AS (
  SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS text
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT DISTINCT doc_id, r.size, p, item_id FROM runs r JOIN win USING (size, text)),
words AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS k FROM (SELECT DISTINCT doc_id, p, size FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WHITE_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda p: array_to_string(w[p : p + 4], ' '))) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM both_in JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM ways UNION SELECT r.x, w.y FROM reach r JOIN ways w ON w.x = r.y),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, y), d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_of ON x = d.doc_id
"""


def _escaped_length(x: str) -> str:
    """Length of x with a backslash for each of its backslashes and control strings."""
    return f"(length({x}) + length({x}) - length(replace({x}, '\\', '')) + len(regexp_extract_all({x}, '</?s>')) + len(regexp_extract_all({x}, '<[|]')) + len(regexp_extract_all({x}, '\\[/?INST\\]')))"


CHAT = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nr, (octet_length(encode(text)) + 3) // 4 + 4 AS cost FROM r),
s AS (SELECT *, nr = 1 AND role = 'system' AS sys, sum(cost) OVER w AS upto, coalesce(max(CASE WHEN nr = 1 AND role = 'system' THEN cost END) OVER w, 0) AS charged FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY nr)),
a AS (SELECT *, greatest((1024 - 256 - charged) // 2, 1) AS half, cost > greatest((1024 - 256 - charged) // 2, 1) AND NOT sys AS alone FROM s),
p AS (SELECT *, 2 * sum(CAST(alone AS INTEGER)) OVER w - CAST(alone AS INTEGER) AS part FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY nr)),
b AS (SELECT *, greatest((sum(CASE WHEN sys THEN 0 ELSE cost END) OVER (PARTITION BY conv_id, part ORDER BY nr) - 1) // half, 0) AS bin FROM p),
c AS (SELECT *, coalesce(lag(part) OVER w <> part, FALSE) OR coalesce(lag(bin) OVER w <> bin, FALSE) AS begins FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY nr)),
d AS (SELECT *, sum(CAST(begins AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY nr) AS win FROM c),
e AS (SELECT *, lead(win) OVER w AS w1, lead(win, 2) OVER w AS w2, lead(upto) OVER w AS to1, max(win) OVER (PARTITION BY conv_id) AS most FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY nr)),
f AS (
  SELECT *, CASE WHEN sys THEN 1 + most - win ELSE 1 + CAST(w1 IS NOT NULL AND w1 <> win AND cost <= 256 AS INTEGER) + CAST(w2 IS NOT NULL AND w2 <> w1 AND to1 - upto + cost <= 256 AS INTEGER) END AS copies,
    8 + {_escaped_length('role')} + 8 + {_escaped_length('text')} + 7 AS size FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nr)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY nr) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(copies * size) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""



def _clusters(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024) -> str:
    """Plain rounds over all vectors, one after another."""
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), vec_id, e) - 1 AS c, e FROM v ORDER BY c LIMIT {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v.e, min((list_sum(list_transform(list_zip(v.e, c.e), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT))), c.c)) AS best FROM v, c{r} c GROUP BY ALL)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT best[2] AS c, unnest(e) AS x, unnest(range({dims})) AS i FROM a{r}) GROUP BY ALL)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.e, c.e) AS e FROM c{r} c LEFT JOIN (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS e FROM s{r} GROUP BY c) n ON n.c = c.c)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.c = best[2]"""


ORACLES = {"op3_decontamination": DECONTAMINATION, "op7_ngram_jaccard_join": NGRAM_JOIN, "op8_chat_format": CHAT, "op13_centroids": _clusters()}

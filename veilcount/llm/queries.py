"""The subpackage's queries, and SQL for those that SQL expresses."""

from __future__ import annotations

from veilcount.llm.ann import op1_ann
from veilcount.llm.balls import CLUSTERS, COMPONENTS, ROUNDS, SEED, op13_balls
from veilcount.llm.decontamination import op11_decontamination
from veilcount.llm.flac import op6_flac
from veilcount.llm.lm_score import op4_lm_score
from veilcount.llm.mixing import op3_mixing
from veilcount.llm.neardup import op7_near_duplicates
from veilcount.llm.negatives import op12_negatives
from veilcount.llm.packing import op8_packing
from veilcount.llm.quality import op2_quality
from veilcount.llm.secrets import op5_secrets
from veilcount.llm.suffixes import op9_suffixes
from veilcount.llm.warc import op10_warc

OPERATORS = (
    op1_ann, op2_quality, op3_mixing, op4_lm_score, op5_secrets,
    op6_flac, op7_near_duplicates, op8_packing, op9_suffixes, op10_warc,
    op11_decontamination, op12_negatives, op13_balls,
)
QUERIES = {f.__name__: f for f in OPERATORS}

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 75 * (m.n + n.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM words UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), component AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM component LEFT JOIN sizes USING (doc_id)
"""

ARCHIVED_PAGES = r"""
WITH own AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    lower(trim(coalesce(url, ''))) AS u FROM pages
), parts AS (
  SELECT *, regexp_replace(regexp_extract(u, '^https?://([^/?#]*)', 1), '^www\.', '') AS host,
    regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^#?]*\?([^#]*)', 1) AS query FROM own
), marked AS (
  SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS original,
    array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END
      || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url_key,
    strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM parts
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to,
  url_key, captured, row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS capture_no
FROM marked
"""

LEAKS = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS x FROM b WHERE len(w) > 0
), spots AS (
  SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw)
), hits AS (
  SELECT r, i, spots.n, item_id FROM spots JOIN bw ON bw.n = spots.n AND bw.x = array_to_string(w[i:i + spots.n - 1], ' ')
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

#: Integer vectors; n: a filter on their number of components.
WHOLE = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"
SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

NEGATIVES = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {WHOLE} AS e FROM embeddings WHERE label IS NOT NULL AND {SOUND}
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 10
"""


def clusters_sql(k: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, seed: str = SEED) -> str:
    """Lloyd's rounds, one after the other."""
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {WHOLE} AS e FROM embeddings WHERE len(embedding) = {components} AND {SOUND})""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, e AS c FROM (SELECT sha256('{seed}:' || vec_id) AS h, e FROM v ORDER BY h LIMIT {k}))"""]
    for i in range(rounds + 1):
        gap = f"CAST(list_sum(list_transform(range(1, {components + 1}), lambda i: (e[i] - c[i]) * (e[i] - c[i]))) AS BIGINT)"
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, e, min(struct_pack(distance := d, cluster := cluster)) AS m FROM (SELECT r, vec_id, e, cluster, {gap} AS d FROM v, c{i}) GROUP BY ALL)""")
        if i < rounds:
            mean = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
            steps.append(f"""u{i} AS (SELECT cluster, list(x ORDER BY place) AS c FROM (SELECT cluster, place, {mean} AS x FROM (SELECT m.cluster AS cluster, unnest(e) AS x, generate_subscripts(e, 1) AS place FROM a{i}) GROUP BY 1, 2) GROUP BY 1)""")
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(u.c, o.c) AS c FROM c{i} o LEFT JOIN u{i} u USING (cluster))""")
    return f"""WITH {", ".join(steps)}, f AS (SELECT vec_id, m.cluster AS cluster, m.distance AS distance FROM a{rounds})
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM f JOIN c{rounds} USING (cluster)"""


ORACLE_SQL = {
    "op7_near_duplicates": NEAR_DUPLICATES,
    "op10_warc": ARCHIVED_PAGES,
    "op11_decontamination": LEAKS,
    "op12_negatives": NEGATIVES,
    "op13_balls": clusters_sql(),
}

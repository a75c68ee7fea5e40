"""DuckDB SQL for near-duplicate classes by brute force over all pairs that share a shingle."""


def near_dup_ctes(words: int, percent: int, docs: str) -> str:
    gram = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(words))
    return rf"""
nd_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
nd_grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words - 2}), lambda i: {gram})
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM nd_words),
nd_sizes AS (SELECT doc_id, count(*) AS n FROM nd_grams GROUP BY doc_id),
nd_pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM nd_grams a JOIN nd_grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
nd_links AS (
  SELECT u, v FROM nd_pairs JOIN nd_sizes x ON x.doc_id = u JOIN nd_sizes y ON y.doc_id = v WHERE 100 * c >= {percent} * (x.n + y.n - c)),
nd_both AS (SELECT u, v FROM nd_links UNION ALL SELECT v, u FROM nd_links),
nd_reach(doc_id, other) AS (SELECT u, v FROM nd_both UNION SELECT r.doc_id, b.v FROM nd_reach r JOIN nd_both b ON b.u = r.other),
nd_classes AS (
  SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.least, d.doc_id))::BIGINT AS component_id
  FROM {docs} d LEFT JOIN nd_sizes s ON d.doc_id = s.doc_id LEFT JOIN (SELECT doc_id, min(other) AS least FROM nd_reach GROUP BY doc_id) r ON d.doc_id = r.doc_id)"""


def near_dup_sql(words: int = 3, percent: int = 85) -> str:
    return f"WITH RECURSIVE {near_dup_ctes(words, percent, 'documents')}\nSELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM nd_classes"

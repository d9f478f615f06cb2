"""The same results in plain SQL, by brute force, where SQL can say them."""

from __future__ import annotations

from leafmill.llm import centroids, license, near_vectors, ngram_join, secrets, spelling, substrings


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_scan() -> str:
    """Places of matches follow from the lengths of what lies between them."""
    parts = []
    for k, rule in enumerate(secrets.RULES):
        # runs of one class are maximal, so asking for the least length finds the same ones, and far fewer
        pattern = _quoted(rule.whole if rule.kind != "hex" else f"[0-9a-f]{{{rule.least},}}")
        value = f"length(m) - length(regexp_extract(m, {_quoted(rule.head)}))" if rule.head else "length(m)"
        parts.append(f"""SELECT r, {k} AS k, {_quoted(rule.kind)} AS kind, start, start + length(m) AS stop FROM (
  SELECT r, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS start
  FROM (SELECT r, regexp_extract_all(text, {pattern}) AS ms, regexp_split_to_array(text, {pattern}) AS gaps FROM docs)) WHERE {value} >= {rule.least}""")
    kinds = ", ".join(f"count(*) FILTER (kind = '{rule.kind}') AS n_{rule.kind}" for rule in secrets.RULES[: secrets.BASE])
    text = "kind || ':' || start || ':' || stop"
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
found AS (SELECT r, {kinds}, string_agg({text}, ',' ORDER BY start, k) FILTER (k < {secrets.BASE}) AS base, string_agg({text}, ',' ORDER BY start, k) AS spans, count(*) FILTER (k >= {secrets.BASE}) AS n_added FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{rule.kind}, 0) AS n_{rule.kind}" for rule in secrets.RULES[: secrets.BASE])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added FROM docs LEFT JOIN found USING (r)"""


def near_vector_pairs() -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {near_vectors.LINK}),
reach(a, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.a),
parts AS (SELECT a AS vec_id, min(c) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM parts LEFT JOIN degree USING (vec_id)"""


def shingle_links() -> str:
    return f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [len(w) || ' ' || array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS MATERIALIZED (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS k FROM x p JOIN x q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2)
 WHERE {ngram_join.DENOMINATOR} * k >= {ngram_join.NUMERATOR} * (na + nb - k)),
reach(a, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.a),
parts AS (SELECT a AS doc_id, min(c) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN parts USING (doc_id)"""


ORACLES = {"op1_secrets": secret_scan(), "op2_near_vectors": near_vector_pairs(), "op3_ngram_join": shingle_links(), "op8_licenses": license.oracle(), "op11_substrings": substrings.oracle(), "op12_spelling": spelling.oracle(), "op13_centroids": centroids.oracle()}

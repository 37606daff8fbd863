"""SQL for the operators that SQL can express: the same rows from plain joins and expressions, without index or sketch."""

from __future__ import annotations

from . import secrets


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The rules of secrets.RULES as expressions without possessive runs, with the letters of the first in either case.
_SECRETS = {
    "assign": (f"""({"|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(part) >= 6"),
    "access": ("AKIA[A-Z0-9]+", "length(hit) >= 20"),
    "hex": ("[0-9a-f]+", "length(hit) >= 24"),
    "private_key": ("-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "true"),
    "github": ("gh[pousr]_[A-Za-z0-9]{36,}", "true"),
    "slack": ("xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
    "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "true"),
    "google": ("AIza[0-9A-Za-z_-]{35}", "true"),
    "stripe": ("[sr]k_live_[0-9A-Za-z]{24,}", "true"),
}


def _spans(no: int, kind: str) -> str:
    """doc_id, kind_no, kind, start, end of a rule's matches: each starts where the pieces and matches before it end."""
    pattern, test = _SECRETS[kind]
    p = pattern.replace("'", "''")
    group = 2 if kind == "assign" else 0
    return f"""
SELECT doc_id, {no} AS kind_no, '{kind}' AS kind, "end" - length(hit) AS start, "end" FROM (
  SELECT doc_id, hit, part, sum(length(piece) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS "end" FROM (
    SELECT doc_id, unnest(range(len(hits))) AS i, unnest(hits) AS hit, unnest(parts) AS part, unnest(pieces[1:len(hits)]) AS piece FROM (
      SELECT doc_id, regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {group}) AS parts, string_split_regex(text, '{p}') AS pieces FROM t WHERE regexp_matches(text, '{p}'))))
WHERE {test}"""


_BASE = tuple(r.kind for r in secrets.BASE)
OP6 = f"""
WITH t AS (SELECT doc_id::BIGINT AS doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_spans(no, r.kind) for no, r in enumerate(secrets.RULES))}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _BASE)},
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, kind_no) FILTER (kind IN {_BASE}) AS base, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, kind_no) AS spans FROM s GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)"""

#: Every two sets that share a shingle are compared, and links are followed to the end.
OP4 = r"""
WITH RECURSIVE w AS (SELECT doc_id::BIGINT AS doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE []::VARCHAR[] END)) AS grams FROM w),
c AS (SELECT md5(array_to_string(grams, chr(10))) AS k, any_value(grams) AS grams, count(*) AS n_docs, min(doc_id) AS least_doc FROM g GROUP BY k),
s AS (SELECT k, len(grams) AS size, unnest(grams) AS gram FROM c WHERE len(grams) > 0),
p AS (SELECT a.k AS a, b.k AS b FROM s a JOIN s b ON a.gram = b.gram AND a.k < b.k GROUP BY a.k, b.k, a.size, b.size HAVING count(*) >= 0.8 * (a.size + b.size - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a AS k, b AS other FROM e UNION SELECT r.k, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT c.k, least(c.least_doc, coalesce(min(o.least_doc), c.least_doc)) AS class_id FROM c LEFT JOIN r ON r.k = c.k LEFT JOIN c o ON o.k = r.other GROUP BY c.k, c.least_doc),
l AS (SELECT e.a AS k, sum(c.n_docs) AS links FROM e JOIN c ON c.k = e.b GROUP BY e.a)
SELECT g.doc_id, m.class_id, (coalesce(l.links, 0) + c.n_docs - 1)::BIGINT AS n_links, len(g.grams)::BIGINT AS n_shingles
FROM g JOIN c ON c.k = md5(array_to_string(g.grams, chr(10))) JOIN m ON m.k = c.k LEFT JOIN l ON l.k = c.k"""

#: Every two sets that share a shingle are compared, and links are followed to the end.
OP12 = r"""
WITH RECURSIVE w AS (SELECT doc_id::BIGINT AS doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE []::VARCHAR[] END)) AS grams FROM w),
d AS (SELECT doc_id, len(grams) AS n, md5(array_to_string(grams, chr(10))) AS k, grams FROM g),
c AS (SELECT k, any_value(grams) AS grams, min(doc_id) AS least_doc FROM d WHERE n > 0 GROUP BY k),
s AS (SELECT k, len(grams) AS size, unnest(grams) AS gram FROM c),
p AS (SELECT a.k AS a, b.k AS b FROM s a JOIN s b ON a.gram = b.gram AND a.k < b.k GROUP BY a.k, b.k, a.size, b.size HAVING 100 * count(*) >= 85 * (a.size + b.size - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a AS k, b AS other FROM e UNION SELECT r.k, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT c.k, least(c.least_doc, coalesce(min(o.least_doc), c.least_doc)) AS component_id FROM c LEFT JOIN r ON r.k = c.k LEFT JOIN c o ON o.k = r.other GROUP BY c.k, c.least_doc)
SELECT d.doc_id, d.n::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(m.component_id, d.doc_id) AS kept FROM d LEFT JOIN m ON m.k = d.k AND d.n > 0"""

#: Every anchor is compared with every row.
OP11 = r"""
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""

_CRC = "list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), lambda s, b: list_reduce(list_concat([xor(s, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END))"

#: Every conversation meets all of its prefixes, and every node those of its smallest member.
OP13 = rf"""
WITH t AS (SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
h AS (SELECT c, xor({_CRC}, 4294967295::UBIGINT) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, 0 AS own, t.place, t.role, t.text FROM h JOIN t ON t.c = h.c - h.c % 20 AND t.place <= h.h
  UNION ALL SELECT t.c, 1, t.place, t.role, t.text FROM h JOIN t USING (c) WHERE t.place > h.h),
s AS (SELECT c, row_number() OVER w AS depth, text, list(md5(length(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY own, place ROWS UNBOUNDED PRECEDING) AS path FROM r WINDOW w AS (PARTITION BY c ORDER BY own, place)),
p AS (SELECT c, depth, md5(array_to_string(path, ',')) AS node, CASE WHEN depth = 1 THEN '' ELSE md5(array_to_string(path[:-2], ',')) END AS parent, len(list_filter(string_split_regex(text, '[ 	-
]+'), lambda x: x <> '')) AS words FROM s
  UNION ALL SELECT c, 0, '', NULL, 0 FROM h),
l AS (SELECT c, max(depth) AS last FROM p GROUP BY c),
n AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last = depth) AS ends FROM p JOIN l USING (c) GROUP BY node),
k AS (SELECT parent, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.parent = n.node),
u AS (SELECT p.node, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved FROM m JOIN p ON p.c = m.conv_id AND p.depth <= m.depth GROUP BY p.node)
SELECT m.conv_id::BIGINT AS conv_id, m.depth::BIGINT AS depth, o.conv_id::BIGINT AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN u USING (node) LEFT JOIN m o ON o.node = m.parent"""

ORACLES: dict[str, str] = {"op4_ngram_jaccard_join": OP4, "op6_secret_scan": OP6, "op11_hard_negatives": OP11, "op12_min_max_near_copies": OP12, "op13_prefix_trie": OP13}

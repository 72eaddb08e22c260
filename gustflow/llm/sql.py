"""DuckDB SQL of the Merkle manifest and of benchmark decontamination."""

from __future__ import annotations

_CRC32 = """xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, length({s}) + 1), lambda i: ord(substr({s}, i, 1))::UBIGINT),
  lambda c, b: list_reduce([xor(c, b)] || list_transform(range(8), lambda i: 0::UBIGINT),
    lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT)"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))) + ")"


def _levels(n: int, nodes: str, paths: str) -> list[str]:
    """CTEs that fold ``nodes``0(tree, i, h) up ``n`` levels of 8 and extend
    ``paths``0(row, tree, i, f, proof) by every level's siblings."""
    out = []
    for k in range(n):
        out.append(f"""{nodes}{k}c AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {nodes}{k}),
{nodes}{k + 1} AS (
  SELECT tree, i // 8 AS i, CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM {nodes}{k}c GROUP BY tree, i // 8),
{paths}{k + 1} AS (
  SELECT row, p.tree, p.i // 8 AS i,
         CASE WHEN max(n) = 1 THEN any_value(f) ELSE sha256(string_agg(CASE WHEN s.i = p.i THEN f ELSE h END, '' ORDER BY s.i)) END AS f,
         any_value(proof) || coalesce(string_agg(h, '' ORDER BY s.i) FILTER (s.i <> p.i), '') AS proof
  FROM {paths}{k} p JOIN {nodes}{k}c s ON s.tree = p.tree AND s.i // 8 = p.i // 8 GROUP BY row, p.tree, p.i // 8)""")
    return out


def merkle(levels: int = 8, tree_levels: int = 3) -> str:
    """Good for 8 ** levels documents a language and 8 ** tree_levels languages."""
    body = ",\n".join([
        f"""base AS (
  SELECT doc_id, coalesce(':' || lang, '') AS tree, {_leaf('text')} AS leaf,
         CASE WHEN {_CRC32.format(s='doc_id::VARCHAR')} % 3 = 0
              THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents),
leaf AS (
  SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS row,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM base),
a0 AS (SELECT tree, i, leaf AS h FROM leaf),
p0 AS (SELECT row, tree, i, coalesce(changed, leaf) AS f, '' AS proof FROM leaf)""",
        *_levels(levels, "a", "p"),
        f"""subroot AS (SELECT tree AS name, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i FROM a{levels}),
b0 AS (SELECT '' AS tree, i, subroot AS h FROM subroot),
t0 AS (SELECT row, '' AS tree, s.i, f, proof FROM p{levels} p JOIN subroot s ON s.name = p.tree)""",
        *_levels(tree_levels, "b", "t")])
    return f"""
WITH {body}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified
FROM leaf JOIN t{tree_levels} t USING (row) JOIN subroot s ON s.name = leaf.tree CROSS JOIN (SELECT h FROM b{tree_levels})"""


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH doc AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT coalesce(item_id::VARCHAR, '-') AS item, {_WORDS} AS w FROM benchmark),
pattern AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, list_slice(w, i, i + least(len(w), 10) - 1) AS g
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM item WHERE len(w) > 0)),
start AS (
  SELECT row, i, m, list_slice(w, i, i + m - 1) AS g
  FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM doc), (SELECT DISTINCT m FROM pattern) WHERE i + m - 1 <= len(w)),
hit AS (SELECT row, i, s.m, item FROM start s JOIN pattern p ON p.m = s.m AND p.g = s.g),
word AS (SELECT row, count(DISTINCT k) AS n FROM (SELECT row, unnest(range(i, i + m)) AS k FROM hit) GROUP BY row),
found AS (SELECT row, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(k.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(k.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN word k USING (row) LEFT JOIN found f USING (row)"""

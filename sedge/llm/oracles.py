"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


def _merkle_sql(levels: int = 12, group_levels: int = 6) -> str:
    """Trees of ``8 ** levels`` rows a group and ``8 ** group_levels`` groups at most."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars"))) + f" || {field(text)})"
    # crc32 of the decimal id, from its table of 256 values.
    table = "list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    crc = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    parts = [
        f"k AS MATERIALIZED (SELECT {table} AS t)",
        f"d AS MATERIALIZED (SELECT *, coalesce('=' || lang, '') AS g, CASE WHEN {crc} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS altered FROM documents, k)",
        f"h AS MATERIALIZED (SELECT g, doc_id, {leaf('text')} AS leaf, {leaf('altered')} AS claimed FROM d)",
        "r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM h)",
        "a0 AS MATERIALIZED (SELECT g, pos, n, leaf AS node FROM r)",
    ]

    def climb(name: str, many: int) -> None:
        for i in range(many):
            parts.append(f"{name}{i + 1} AS MATERIALIZED (SELECT g, pos // 8 AS pos, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) = 1 THEN min(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node FROM {name}{i} GROUP BY g, pos // 8)")

    def fold(name: str, many: int, out: str, begin: str) -> None:
        """Each row's node and siblings through the levels of one tree."""
        before = begin
        for i in range(many):
            s = f"SELECT b.row AS row, coalesce(string_agg(x.node, '' ORDER BY x.pos) FILTER (x.pos < b.pos // {8**i}), '') AS l, coalesce(string_agg(x.node, '' ORDER BY x.pos) FILTER (x.pos > b.pos // {8**i}), '') AS r, any_value(x.n) AS n FROM {before} b JOIN {name}{i} x ON x.g = b.g AND x.pos // 8 = b.pos // {8 ** (i + 1)} GROUP BY b.row"
            parts.append(f"{out}{i} AS MATERIALIZED (SELECT b.* REPLACE (CASE WHEN s.n = 1 THEN b.folded ELSE sha256(s.l || b.folded || s.r) END AS folded, CASE WHEN s.n = 1 THEN b.path ELSE b.path || s.l || s.r END AS path) FROM {before} b JOIN ({s}) s ON s.row = b.row)")
            before = f"{out}{i}"

    climb("a", levels)
    parts.append(f"b0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, node, g AS part FROM a{levels})")
    climb("b", group_levels)
    parts.append("f AS MATERIALIZED (SELECT row_number() OVER () AS row, g, pos, doc_id, leaf, claimed AS folded, '' AS path FROM r)")
    fold("a", levels, "p", "f")
    parts.append(f"q AS MATERIALIZED (SELECT p.row, '' AS g, b0.pos, p.doc_id, p.leaf, p.folded, p.path, b0.node AS subroot, p.g AS part, p.pos AS position FROM p{levels - 1} p JOIN b0 ON b0.part = p.g)")
    fold("b", group_levels, "u", "q")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, (SELECT node FROM b{group_levels}) AS root, sha256(path) AS proof_sha256, folded AS folded_root, folded = (SELECT node FROM b{group_levels}) AS verified, CASE WHEN part <> '' THEN part[2:] END AS lang, position FROM u{group_levels - 1}"


ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
""",
    "op11_merkle_manifest": _merkle_sql(),
    "op12_mtree_topk": r"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5
""",
    "op13_phrases": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: ws[i : i + size - 1])) AS gram FROM w, (SELECT unnest([1, 2, 3, 4]) AS size)),
f AS MATERIALIZED (SELECT lang, size, gram, count(*) AS f FROM g GROUP BY ALL HAVING f >= 30),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE size > 1),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (SELECT k.lang, k.gram, k.size, k.k, k.f AS a, x.f AS l, y.f AS r, (2000000::HUGEINT * k.f // (x.f + y.f))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.gram = k.gram[1 : k.k] JOIN f y ON y.lang = k.lang AND y.gram = k.gram[k.k + 1 :]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1),
v AS (SELECT lang, gram[i : i + wide - 1] AS gram, max(f) AS longer FROM (SELECT *, unnest(range(1, size - wide + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS wide FROM c)) GROUP BY 1, 2),
o AS (SELECT b.*, array_to_string(b.gram, ' ') AS phrase FROM b LEFT JOIN v ON v.lang = b.lang AND v.gram = b.gram WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM o)
SELECT t.lang, rank, phrase, a, l, r, n.n, score FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000
""",
}

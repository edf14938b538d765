"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from .centroids import CENTROIDS, DIMS, ROUNDS, SCALE
from .merkle import ARITY, COLUMNS

LEVELS = 6  # of a tree: up to 16^6 rows of a source


def _leaf(text: str) -> str:
    values = (f"CAST({text if c == 'text' else c} AS VARCHAR)" for c in COLUMNS)
    return "sha256(" + " || ".join(f"coalesce(CAST(octet_length(encode({v})) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"


def _crc32(text: str) -> str:
    """A bit at a time: each byte is taken in at the first of its eight steps."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda a, b: {step}), 4294967295)"


def _tree(name: str, leaves: str) -> list[str]:
    """name0 to nameN: the nodes (tree, pos, digest, n) of each level, as they are once a tree has one node; leaves: tree, pos, digest."""
    out = [f"{name}0 AS MATERIALIZED (SELECT tree, pos, digest, count(*) OVER (PARTITION BY tree) AS n FROM ({leaves}))"]
    for k in range(LEVELS):
        up = f"SELECT tree, pos // {ARITY} AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE any_value(digest) END AS digest FROM {name}{k} GROUP BY ALL"
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, pos, digest, count(*) OVER (PARTITION BY tree) AS n FROM ({up}))")
    return out


def _climb(before: str, name: str, tree: str, at: str) -> list[str]:
    """From before (at0 and own of each row), a relation for each level: the siblings' digests added to beside, own folded with them."""
    out = []
    for k in range(LEVELS):
        run = f"SELECT x.k, x.own, any_value(x.beside) AS beside, any_value(x.here) AS here, any_value(x.n) AS n, list(struct_pack(pos := y.pos, d := y.digest) ORDER BY y.pos) AS run FROM (SELECT p.*, q.n, p.{at} // {ARITY ** k} AS here FROM {before} p JOIN {name}{k} q ON q.tree = p.{tree} AND q.pos = p.{at} // {ARITY ** k}) x JOIN {name}{k} y ON y.tree = x.{tree} AND y.pos // {ARITY} = x.here // {ARITY} GROUP BY x.k, x.own"
        cut = "coalesce(array_to_string(list_transform(list_filter(run, lambda e: e.pos <> here), lambda e: e.d), ''), '')"
        fold = "array_to_string(list_transform(run, lambda e: CASE WHEN e.pos = here THEN own ELSE e.d END), '')"
        now = f"SELECT k, CASE WHEN n > 1 THEN sha256({fold}) ELSE own END AS own, CASE WHEN n > 1 THEN beside || {cut} ELSE beside END AS beside FROM ({run})"
        out.append(f"{before}_{name}{k} AS MATERIALIZED (SELECT r.k, r.own, r.beside, l.tree, l.pos, 0 AS over FROM ({now}) r JOIN base l USING (k))")
        before = f"{before}_{name}{k}"
    return out


def _manifest() -> str:
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"raw AS MATERIALIZED (SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_leaf(lowered)} END AS shown FROM documents)",
        "base AS MATERIALIZED (SELECT *, row_number() OVER () AS k, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM raw)",
        *_tree("s", "SELECT tree, pos, leaf AS digest FROM base"),
        *_tree("t", f"SELECT 0 AS tree, tree AS pos, digest FROM s{LEVELS}"),
        "start AS (SELECT k, coalesce(shown, leaf) AS own, '' AS beside, tree, pos, 0 AS over FROM base)",
        *_climb("start", "s", "tree", "pos"),
    ]
    last = "start" + "".join(f"_s{k}" for k in range(LEVELS))
    parts += _climb(last, "t", "over", "tree")
    last += "".join(f"_t{k}" for k in range(LEVELS))
    return (
        f"WITH {', '.join(parts)} SELECT b.doc_id, b.leaf, s.digest AS subroot, t.digest AS root, sha256(f.beside) AS proof_sha256, f.own AS folded_root, f.own = t.digest AS verified "
        f"FROM base b JOIN s{LEVELS} s USING (tree) JOIN {last} f USING (k) CROSS JOIN t{LEVELS} t"
    )


def _clusters() -> str:
    """Distances by component; each round names its centroids c<k> (number, place, component) and its assignment a<k>."""
    finite = "x IS NOT NULL AND isfinite(x)"
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: {finite})) = {DIMS})",
        "p AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept)",
        f"first AS (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c FROM kept QUALIFY c < {CENTROIDS})",
        "c0 AS MATERIALIZED (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM first)",
    ]
    for k in range(ROUNDS + 1):
        far = f"SELECT p.r, c.c, sum((p.x - c.x) * (p.x - c.x)) AS d FROM p JOIN c{k} c USING (i) GROUP BY ALL"
        parts.append(f"a{k} AS MATERIALIZED (SELECT r, c, d FROM ({far}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if k < ROUNDS:
            mean = f"SELECT a.c, p.i, sum(p.x) AS s, count(*) AS n FROM a{k} a JOIN p USING (r) GROUP BY ALL"
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT o.c, o.i, CASE WHEN m.n IS NULL THEN o.x ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS x FROM c{k} o LEFT JOIN ({mean}) m ON m.c = o.c AND m.i = o.i)")
    told = f"SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY c"
    return (
        f"WITH {', '.join(parts)} SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(a.d) OVER () AS BIGINT) AS inertia, t.h AS centroid_sha256 FROM kept k JOIN a{ROUNDS} a USING (r) JOIN ({told}) t USING (c)"
    )


MANIFEST = _manifest()
CLUSTERS = _clusters()

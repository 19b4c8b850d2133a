"""SQL twins that are put together from repeated steps."""

from __future__ import annotations

from segue.llm import centroids, merkle

_DISTANCE = "list_sum(list_transform(list_zip({}, {}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _clusters() -> str:
    """The rounds of clustering, one after the other."""
    steps = []
    for k in range(centroids.ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT row_id, vec_id, v, d[1] AS distance, d[2] AS cluster FROM (SELECT p.row_id, any_value(p.vec_id) AS vec_id, any_value(p.v) AS v, "
                     f"min([{_DISTANCE.format('p.v', 'c.v')}, c.cluster]) AS d FROM points p, c{k} c GROUP BY p.row_id))")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT cluster, list(x ORDER BY j) AS v FROM "
                     f"(SELECT cluster, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{k}) GROUP BY 1, 2) GROUP BY 1) m USING (cluster))")
    return ",\n".join(steps[:-1])


_LAST = centroids.ROUNDS
CENTROIDS = f"""WITH points AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {centroids.SCALE}) AS BIGINT)) AS v FROM embeddings
   WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(CAST(x AS DOUBLE) * {centroids.SCALE}) < {centroids.LARGEST})) = {centroids.DIMENSIONS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v FROM points WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {centroids.CENTROIDS})),
{_clusters()}
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
   CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{_LAST} a JOIN c{_LAST} c USING (cluster)"""

#: Levels that the twin unrolls: leaves a language and languages may number two to these powers.
_LEAF_LEVELS, _LANG_LEVELS = 24, 10
_CRC = ("xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), "
        "lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)))")


def _leaf(n_chars: str) -> str:
    values = [n_chars if f == "n_chars" else f for f in merkle.FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"


def _levels(prefix: str, count: int) -> str:
    """Each level as a table of (ns, lang, i, h, n), n being the size of the first level."""
    return ",\n".join(
        f"{prefix}{k + 1} AS MATERIALIZED (SELECT ns, lang, CASE WHEN n > {2 ** k} THEN i // 2 ELSE i END AS i, CASE WHEN any_value(n) > {2 ** k} THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, any_value(n) AS n "
        f"FROM {prefix}{k} GROUP BY 1, 2, 3, n)" for k in range(count))


def _walk(prefix: str, tree: str, first: str, count: int) -> str:
    """Each leaf's way up: path of siblings and folded digest."""
    steps = [f"{prefix}0 AS MATERIALIZED ({first})"]
    for k in range(count):
        steps.append(f"{prefix}{k + 1} AS MATERIALIZED (SELECT p.* REPLACE (CASE WHEN p.n > {2 ** k} THEN p.i // 2 ELSE p.i END AS i, CASE WHEN p.n > {2 ** k} THEN path || coalesce(s.h, '') ELSE path END AS path, "
                     f"CASE WHEN p.n <= {2 ** k} THEN folded WHEN p.i % 2 = 0 THEN sha256(folded || coalesce(s.h, '')) ELSE sha256(s.h || folded) END AS folded) "
                     f"FROM {prefix}{k} p LEFT JOIN {tree}{k} s ON s.ns = p.ns AND s.lang = p.lang AND s.i = xor(p.i, 1))")
    return ",\n".join(steps)


MANIFEST = f"""WITH leaves AS MATERIALIZED (SELECT doc_id, lang IS NULL AS ns, coalesce(lang, '') AS lang, {_leaf('n_chars')} AS leaf,
   {_leaf(f'(CASE WHEN doc_id IS NOT NULL AND {_CRC} % 7 = 0 THEN n_chars::HUGEINT + 1 ELSE n_chars END)')} AS changed FROM documents),
base AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ns, lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY ns, lang) AS n FROM leaves),
l0 AS MATERIALIZED (SELECT ns, lang, i, leaf AS h, n FROM base),
{_levels('l', _LEAF_LEVELS)},
langs AS MATERIALIZED (SELECT ns AS is_null, lang AS named, h AS subroot, row_number() OVER (ORDER BY ns DESC, lang) - 1 AS i, count(*) OVER () AS n FROM l{_LEAF_LEVELS}),
t0 AS MATERIALIZED (SELECT true AS ns, '' AS lang, i, subroot AS h, n FROM langs),
{_levels('t', _LANG_LEVELS)},
{_walk('p', 'l', "SELECT doc_id, leaf, ns, lang, i, n, '' AS path, changed AS folded FROM base", _LEAF_LEVELS)},
{_walk('q', 't', f"SELECT doc_id, leaf, subroot, true AS ns, '' AS lang, langs.i, langs.n, path, folded FROM p{_LEAF_LEVELS} p JOIN langs ON is_null = p.ns AND named = p.lang", _LANG_LEVELS)}
SELECT doc_id, leaf, subroot, t.h AS root, sha256(path) AS proof_sha256, folded AS folded_root, folded = t.h AS verified FROM q{_LANG_LEVELS}, t{_LANG_LEVELS} t"""

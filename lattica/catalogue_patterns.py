"""Registered queries of patterns, motifs, triads and graph classes, with SQL that lists every embedding."""

from __future__ import annotations

from lattica.catalogue import BOTH, DEG, TREE, register, tree
from lattica.catalogue_centrality import _DT, strong_trade
from lattica.catalogue_profiles import PARTNERS, partners
from lattica.operators import patterns


def count_sql(name: str) -> str:
    """SQL: induced copies of a pattern, all embeddings over its automorphisms; b is the simple adjacency both ways."""
    n, edges = patterns.PATTERNS[name]
    order = patterns._sequence((n, edges))
    kept, source, rules = {frozenset(e) for e in edges}, f"(SELECT DISTINCT v AS p FROM b) x{order[0]}", []
    for k in range(1, n):
        new = order[k]
        for i in order[:k]:
            if frozenset((i, new)) not in kept:
                rules += [f"x{i}.p <> x{new}.p", f"NOT EXISTS (SELECT 1 FROM b WHERE b.v = x{i}.p AND b.u = x{new}.p)"]
        ties = [i for i in order[:k] if frozenset((i, new)) in kept]
        source += f" JOIN (SELECT v, u AS p FROM b) x{new} ON x{new}.v = x{ties[0]}.p"
        source += "".join(f" JOIN b b{i}_{new} ON b{i}_{new}.v = x{i}.p AND b{i}_{new}.u = x{new}.p" for i in ties[1:])
    return f"(SELECT count(*) // {len(patterns.automorphisms((n, edges)))} FROM {source}{' WHERE ' + ' AND '.join(rules) if rules else ''})"


_SMALL = [x for x in patterns.PATTERNS if patterns.PATTERNS[x][0] < 5]
for _end, _graph, _sql in (("", partners, PARTNERS), ("_tree", tree, TREE)):
    register(f"pattern_counts{_end}", f"WITH {_sql}, {BOTH} " + " UNION ALL ".join(f"SELECT '{x}' AS name, {count_sql(x)} AS copies" for x in _SMALL))(lambda s, p, g=_graph: patterns.pattern_counts(g(s, p), _SMALL))
register("large_pattern_counts", f"WITH {PARTNERS}, {BOTH} " + " UNION ALL ".join(f"SELECT '{x}' AS name, {count_sql(x)} AS copies" for x in patterns.PATTERNS if x not in _SMALL))(lambda s, p: patterns.pattern_counts(partners(s, p), [x for x in patterns.PATTERNS if x not in _SMALL]))
register("forbidden_classes", f"WITH {PARTNERS}, {BOTH}, fb AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{x}' AS x, {count_sql(x)} AS k" for x in sorted({p for ps in patterns.FORBIDDEN.values() for p in ps})) + ") " + " UNION ALL ".join(
    f"SELECT '{n}' AS name, (SELECT sum(k) FROM fb WHERE x IN ({', '.join(repr(p) for p in ps)})) = 0 AS value" for n, ps in patterns.FORBIDDEN.items()
))(lambda s, p: patterns.forbidden_classes(partners(s, p)))
for _size in (3, 4):
    register(f"motifs_{_size}", f"WITH {PARTNERS}, {BOTH} " + " UNION ALL ".join(f"SELECT '{x}' AS name, {count_sql(x)} AS copies" for x in (["p3", "triangle"] if _size == 3 else ["claw", "p4", "c4", "paw", "diamond", "k4"])))(lambda s, p, k=_size: patterns.motifs(partners(s, p), k))

# the census by looking at all triples
_ST = "(CASE WHEN EXISTS (SELECT 1 FROM e WHERE src = {0}.v AND dst = {1}.v) THEN 1 ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM e WHERE src = {1}.v AND dst = {0}.v) THEN 2 ELSE 0 END)"
_CASES = " ".join(f"WHEN {code} THEN '{name}'" for code, name in patterns._triad_names().items())
register("triad_census", (
    f"WITH {_DT}, t AS (SELECT {_ST.format('x', 'y')} + 4 * {_ST.format('x', 'z')} + 16 * {_ST.format('y', 'z')} AS code FROM vs x JOIN vs y ON x.v < y.v JOIN vs z ON y.v < z.v), c AS (SELECT CASE code {_CASES} END AS name, count(*) AS k FROM t GROUP BY 1), "
    f"n AS (SELECT unnest([{', '.join(repr(x) for x in sorted(set(patterns._triad_names().values())))}]) AS name) SELECT n.name, coalesce(k, 0) AS triads FROM n LEFT JOIN c ON n.name = c.name"
))(lambda s, p: patterns.triad_census(strong_trade(s, p)))
register("edge_clustering", f"WITH {PARTNERS}, {DEG} SELECT src AS a, dst AS b, CAST(CAST((SELECT count(*) FROM b x JOIN b y ON x.u = y.u WHERE x.v = src AND y.v = dst) / nullif(least(du, dv) - 1, 0) AS FLOAT) AS DOUBLE) AS ecc FROM ed")(lambda s, p: patterns.ecc(partners(s, p)))

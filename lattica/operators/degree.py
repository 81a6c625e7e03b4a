"""Measures of the degree sequence and of the degrees at the ends of edges.

Sums over edges need one join of edges with degrees, sums over vertices one aggregation; all names of a
call are computed in one pass. Everything about the degree distribution starts from the table of degree
classes, which has at most as many rows as there are distinct degrees.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import formulas as T
from lattica.graph import Graph, real


def _long(row: DataFrame, names: Iterable[str]) -> DataFrame:
    """A row of columns as rows (name, value)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("double").alias("value")) for n in names])
    return row.select(F.explode(pairs).alias("p")).select("p.name", real("p.value").alias("value"))


def _sum(value: str, rows: str) -> Column:
    return F.coalesce(F.sum(F.expr(f"case when {rows} then {value} end")), F.lit(0.0))


def _product(value: str, rows: str) -> Column:
    return F.exp(F.coalesce(F.sum(F.expr(f"case when {rows} then ln({value}) end")), F.lit(0.0)))


def edge_indices(graph: Graph, names: Iterable[str] | None = None, a: float | None = None) -> DataFrame:
    """(name, value) of sums and products over edges that aren't loops; names with a parameter need ``a``."""
    table = {n: _sum(*x) for n, x in T.EDGE_SUMS.items()} | {n: _product(*x) for n, x in T.EDGE_PRODUCTS.items()}
    if a is not None:
        table = {n: _sum(x.format(a=a), rows) for n, (x, rows) in T.EDGE_POWERS.items()}
    table["second_zagreb_index"] = F.coalesce(F.sum(F.expr("du * dv")), F.lit(0.0))
    chosen = list(names) if names is not None else list(table)
    rows = graph.edge_degrees.where("src != dst" if chosen != ["second_zagreb_index"] else "true")
    return _long(rows.agg(*[table[T.ALIASES.get(n, n)].alias(n) for n in chosen]), chosen)


def vertex_indices(graph: Graph, names: Iterable[str] | None = None, a: float | None = None) -> DataFrame:
    """(name, value) of sums and products over vertices; from degree classes, so a vertex is looked at once."""
    classes = degree_distribution(graph).withColumn("d", F.col("degree").cast("double"))
    weighted = lambda x, rows: F.coalesce(F.sum(F.expr(f"case when {rows} then n_vertices * ({x}) end")), F.lit(0.0))
    table = {n: weighted(*x) for n, x in T.VERTEX_SUMS.items()}
    table |= {n: F.exp(weighted(f"ln({x})", rows)) for n, (x, rows) in T.VERTEX_PRODUCTS.items()}
    if a is not None:
        table = {n: weighted(x.format(a=a), rows) for n, (x, rows) in T.VERTEX_POWERS.items()}
    chosen = list(names) if names is not None else list(table)
    return _long(classes.agg(*[table[n].alias(n) for n in chosen]), chosen)


def edge_entropies(graph: Graph) -> DataFrame:
    """(name, value): ln S - (sum of w ln w) / S, which is the entropy of the shares w / S, in one pass."""
    made = {}
    for n, (w, rows) in T.EDGE_ENTROPIES.items():
        total = F.sum(F.expr(f"case when {rows} then {w} end"))
        made[n] = F.coalesce(F.log(total) - F.sum(F.expr(f"case when {rows} then ({w}) * ln({w}) end")) / total, F.lit(0.0))
    return _long(graph.edge_degrees.where("src != dst").agg(*[c.alias(n) for n, c in made.items()]), made)


def coindices(graph: Graph, names: Iterable[str] | None = None) -> DataFrame:
    """(name, value): sums over pairs that aren't edges, from pairs of degree classes less edges; total_irregularity is half the sum over all pairs.

    For simple graphs. The pair table has the square of the number of distinct degrees, not of vertices, as rows.
    """
    chosen = list(names) if names is not None else list(T.COINDICES)
    classes = degree_distribution(graph)
    x, y = classes.select(F.col("degree").cast("double").alias("du"), F.col("n_vertices").alias("nu")), classes.select(F.col("degree").cast("double").alias("dv"), F.col("n_vertices").alias("nv"))
    pairs = x.join(y, F.col("du") <= F.col("dv")).withColumn("k", F.expr("case when du = dv then nu * (nu - 1) / 2.0 else nu * nv * 1.0 end"))
    over_pairs = pairs.agg(*[F.sum(F.col("k") * F.expr(T.COINDICES[n])).alias(f"p_{n}") for n in chosen])
    over_edges = graph.edge_degrees.where("src != dst").agg(*[F.coalesce(F.sum(F.expr(T.COINDICES[n])), F.lit(0.0)).alias(f"e_{n}") for n in chosen])
    both = over_pairs.withColumn("one", F.lit(1)).join(over_edges.withColumn("one", F.lit(1)), "one")
    return _long(both.select(*[(F.col(f"p_{n}") / 2 if n == "total_irregularity" else F.col(f"p_{n}") - F.col(f"e_{n}")).alias(n) for n in chosen]), chosen)


def degree_distribution(graph: Graph, mode: str = "all") -> DataFrame:
    """(degree, n_vertices)."""
    return graph.degrees(mode).groupBy(F.col("d").alias("degree")).agg(F.count("*").alias("n_vertices"))


def degree_statistics(graph: Graph) -> DataFrame:
    """(name, value) of the measures of the degree sequence, all from degree classes.

    Running counts over the classes give ranks, so Gini, Palma and the quantiles need no sort of vertices.
    """
    classes = degree_distribution(graph).select(F.col("degree").cast("double").alias("d"), F.col("n_vertices").cast("double").alias("k"))
    whole = Window.partitionBy(F.lit(0))  # a row for each distinct degree
    up = Window.partitionBy(F.lit(0)).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    t = classes.withColumn("n", F.sum("k").over(whole)).withColumn("s", F.sum(F.expr("k * d")).over(whole)).withColumn("before", F.coalesce(F.sum("k").over(up), F.lit(0.0)))
    t = t.withColumn("mean", F.expr("s / n"))

    def quantile(p: float) -> Column:
        at = F.expr(f"(n - 1) * {p}D")
        value = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("k")), F.col("d")))
        low, high, share = value(F.floor(at)), value(F.ceil(at)), F.max(at - F.floor(at))
        return low + (high - low) * share

    low, high = "least(k, greatest(0.0D, floor(0.4D * n) - before))", "least(k, greatest(0.0D, before + k - (n - floor(0.1D * n))))"
    t = t.agg(
        F.max("n").alias("n"), F.max("s").alias("s"), F.max("mean").alias("mean"), F.max("d").alias("top"), F.min("d").alias("bottom"), F.count("*").alias("kinds"),
        F.sum(F.expr("k * power(d - mean, 2)")).alias("m2"), F.sum(F.expr("k * power(d - mean, 3)")).alias("m3"), F.sum(F.expr("k * power(d - mean, 4)")).alias("m4"),
        F.sum(F.expr("k * abs(d - mean)")).alias("dev"), F.max(F.expr("abs(d - mean)")).alias("far"), F.sum(F.expr("k * d * d")).alias("q"),
        F.sum(F.expr("-k / n * ln(k / n)")).alias("h"), F.sum(F.expr("case when d > 0 then k * (d / mean) * ln(d / mean) else 0 end")).alias("th"),
        F.sum(F.expr("k * d * (2 * before + k - n)")).alias("gini"), F.sum(F.expr("case when d > 0 then -k * (d / s) * ln(d / s) else 0 end")).alias("walk"),
        F.max_by("d", F.struct("k", -F.col("d"))).alias("mode"), F.max("k").alias("mode_k"), F.sum(F.expr("case when d = 1 then k else 0 end")).alias("ones"), F.sum(F.expr("case when d = 0 then k else 0 end")).alias("zeros"),
        F.sum(F.expr("case when d >= mean - 1e-12 then k else 0 end")).alias("core"), F.sum(F.expr("case when d >= 2 * mean - 1e-12 then k else 0 end")).alias("tail"), F.sum(F.expr("case when d > mean + 1e-15 then k else 0 end")).alias("hubs"),
        F.max(F.expr("case when before + k < n then d end")).alias("below"), F.max(F.expr("case when before + k = n then k end")).alias("top_k"),
        F.sum(F.expr(f"d * {low}")).alias("low"), F.sum(F.expr(f"d * {high}")).alias("high"), quantile(0.5).alias("median"), quantile(0.25).alias("q1"), quantile(0.75).alias("q3"),
    )
    made = {
        "degree_mad": "dev / n", "degree_entropy_ln": "h", "degree_entropy": "h / ln(2)", "degree_entropy_normalized": "case when n < 2 then 0 else h / ln(n) end", "degree_entropy_ratio": "case when n < 2 then 0 else h / ln(n) end",
        "degree_herfindahl": "q / (s * s)", "degree_theil": "th / n", "degree_palma": "high / low", "degree_hoover": "dev / (2 * s)", "degree_variance": "m2 / n", "degree_cv": "sqrt(m2 / n) / mean",
        "degree_skewness": "case when n < 3 or m2 = 0 then 0 else m3 / n / power(m2 / n, 1.5) end", "degree_kurtosis": "case when n < 3 or m2 = 0 then 0 else m4 / n / power(m2 / n, 2) - 3 end",
        "degree_gini": "gini / (n * s)", "degree_max_deviation": "far", "degree_mode": "mode", "degree_concentration": "mode_k / n", "degree_diversity": "kinds", "hub_dominance": "top / s", "hub_dominance_ratio": "2 * top / s",
        "degree_range": "top - bottom", "degree_span_ratio": "(top - bottom) / mean", "degree_leaf_ratio": "ones / n", "degree_isolated_ratio": "zeros / n", "degree_core_ratio": "core / n", "degree_tail_ratio": "tail / n",
        "hub_ratio": "hubs / n", "leaf_to_hub_ratio": "case when hubs = 0 then 0 else ones / hubs end", "freeman_degree_centralization": "(n * top - s) / ((n - 1) * (n - 2))", "connectivity_index": "mean / (n - 1)", "edge_vertex_ratio": "s / 2 / n",
        "degree_variance_ratio": "m2 / n / ((n - 1) * (n - 1) / 4)", "degree_range_ratio": "case when bottom = 0 then 0 else bottom / top end", "degree_spectral_gap_estimate": "case when top_k > 1 then 0 else (top - below) / top end",
        "structural_information_content": "log2(kinds) / log2(n)", "walk_entropy": "walk", "walk_regularity": "1 - sqrt(m2 / n) / mean", "degree_laplacian_energy": "dev / (n * top)", "even_odd_walk_ratio": "q / s",
        "von_neumann_entropy": "greatest(0, 1 - 1 / n - q / (s * s))", "degree_median": "median", "degree_iqr": "q3 - q1", "max_degree": "top", "min_degree": "bottom", "mean_degree": "mean", "density": "s / 2 / n / (n - 1) * 2",
    }
    return _long(t.select(*[F.expr(x).alias(n) for n, x in made.items()]), made)


def edge_degree_statistics(graph: Graph) -> DataFrame:
    """(name, value): covariance, correlation and spread of end degrees, taken as stored (src, dst); degree-pair entropies."""
    e = graph.edge_degrees
    moments = e.agg(
        F.count("*").alias("m"), F.avg("du").alias("x"), F.avg("dv").alias("y"), F.avg(F.expr("du * dv")).alias("xy"), F.avg(F.expr("du * du")).alias("xx"), F.avg(F.expr("dv * dv")).alias("yy"),
        F.avg(F.expr("power(du - dv, 2)")).alias("gap"), F.avg(F.expr("(du + dv) / 2")).alias("half"), F.avg(F.expr("(du * du + dv * dv) / 2")).alias("sq"),
    )
    made = {
        "edge_degree_covariance": "xy - x * y", "edge_degree_pearson": "case when xx - x * x <= 0 or yy - y * y <= 0 then 0 else (xy - x * y) / sqrt((xx - x * x) * (yy - y * y)) end", "edge_degree_cosine": "xy / sqrt(xx * yy)",
        "edge_degree_discrepancy": "gap / 4", "edge_degree_rms": "sqrt(sq)", "assortativity_degree": "case when sq - half * half = 0 then null else (xy - half * half) / (sq - half * half) end",
    }
    pairs = e.where("src != dst").groupBy(F.least("du", "dv").alias("a"), F.greatest("du", "dv").alias("b")).agg(F.count("*").cast("double").alias("k"))
    pairs = pairs.withColumn("m", F.sum("k").over(Window.partitionBy(F.lit(0))))  # a row for each pair of degrees
    spread = pairs.agg(F.sum(F.expr("-k / m * ln(k / m)")).alias("h"), F.count("*").alias("kinds"), (F.max("k") / F.max("m")).alias("most"))
    of_pairs = {"edge_degree_entropy": "h", "edge_weight_balance": "case when kinds < 2 then 0 else h / ln(kinds) end", "degree_pair_concentration": "most"}
    first = _long(moments.select(*[F.expr(x).alias(n) for n, x in made.items()]), made)
    return first.unionByName(_long(spread.select(*[F.expr(x).alias(n) for n, x in of_pairs.items()]), of_pairs))

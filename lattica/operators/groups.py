"""Measures of a labelling of vertices, and of numbers on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph, real


def _with_ends(g: Graph, values: DataFrame, column: str) -> DataFrame:
    a, b = (values.select(F.col("v").alias(end), F.col(column).alias(name)) for end, name in (("src", "x"), ("dst", "y")))
    return g.edges.join(a, "src").join(b, "dst")


def _named(row: DataFrame, names: list[str]) -> DataFrame:
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), real(F.col(c).cast("double")).alias("value")) for c in names])).alias("p")).select("p.*")


def partition_measures(g: Graph, labels: DataFrame, label: str = "label") -> DataFrame:
    """(name, value): modularity, cut_size, edge_homophily, assortativity_nominal, coverage, normalized_cut, ratio_cut, max_conductance."""
    e = _with_ends(g, labels, label)
    inside = e.groupBy(F.col("x").alias("c")).agg(F.count_if(F.col("x") == F.col("y")).alias("within"))
    volume = g.degrees().join(labels.select("v", F.col(label).alias("c")), "v").groupBy("c").agg(F.sum("d").alias("vol"), F.count("*").alias("size"))
    per = volume.join(inside, "c", "left").withColumn("within", F.coalesce("within", F.lit(0)).cast("double")).withColumn("vol", F.col("vol").cast("double")).withColumn("cut", F.col("vol") - 2 * F.col("within"))
    t = per.agg(F.sum("within").alias("w"), F.sum("vol").alias("m2"), F.sum(F.expr("vol * vol")).alias("v2"), F.sum(F.expr("case when vol > 0 then cut / vol end")).alias("ncut"), F.sum(F.expr("cut / size")).alias("rcut"), F.max(F.expr("case when vol > 0 then cut / vol end")).alias("cond"))
    t = t.select(
        F.expr("2 * w / m2 - v2 / (m2 * m2)").alias("modularity"), F.expr("m2 / 2 - w").alias("cut_size"), F.expr("2 * w / m2").alias("edge_homophily"), F.expr("(2 * w / m2 - v2 / (m2 * m2)) / (1 - v2 / (m2 * m2))").alias("assortativity_nominal"),
        F.expr("2 * w / m2").alias("coverage"), F.expr("ncut").alias("normalized_cut"), F.expr("rcut").alias("ratio_cut"), F.expr("cond").alias("max_conductance"),
    )
    return _named(t, t.columns)


def node_homophily(g: Graph, labels: DataFrame, label: str = "label") -> DataFrame:
    """(v, share): of the neighbour slots, those with the vertex's own label."""
    x = g.slots.join(labels.select("v", F.col(label).alias("x")), "v").join(labels.select(F.col("v").alias("u"), F.col(label).alias("y")), "u")
    return x.groupBy("v").agg(real(F.avg((F.col("x") == F.col("y")).cast("double"))).alias("share"))


def joint_type_distribution(g: Graph, labels: DataFrame, label: str = "label") -> DataFrame:
    """(x, y, n): edge ends by label pair, both ways."""
    x = g.slots.join(labels.select("v", F.col(label).alias("x")), "v").join(labels.select(F.col("v").alias("u"), F.col(label).alias("y")), "u")
    return x.groupBy("x", "y").agg(F.count("*").alias("n"))


def joint_degree_matrix(g: Graph) -> DataFrame:
    """(du, dv, n): edges by the degrees of their ends, du <= dv."""
    return g.edge_degrees.groupBy(F.least("du", "dv").cast("long").alias("du"), F.greatest("du", "dv").cast("long").alias("dv")).agg(F.count("*").alias("n"))


def avg_nearest_neighbor_degree(g: Graph) -> DataFrame:
    """(v, knn): the mean degree of the neighbour slots."""
    d = g.degrees()
    return g.slots.join(d.select(F.col("v").alias("u"), "d"), "u").groupBy("v").agg(real(F.avg("d")).alias("knn"))


def knnk(g: Graph) -> DataFrame:
    """(degree, knnk): the mean of knn over vertices of a degree."""
    d = g.degrees()
    knn = g.slots.join(d.select(F.col("v").alias("u"), F.col("d").alias("du")), "u").groupBy("v").agg(F.avg("du").alias("knn"))
    return knn.join(d, "v").groupBy(F.col("d").alias("degree")).agg(real(F.avg("knn")).alias("knnk"))


def signal_measures(g: Graph, signal: DataFrame, value: str = "value") -> DataFrame:
    """(name, value): dirichlet_energy, total_variation, normalized_dirichlet_energy, smoothness_ratio, assortativity of numbers on vertices."""
    t = _with_ends(g, signal, value).agg(
        F.sum(F.expr("power(x - y, 2)")).alias("e"), F.sum(F.expr("abs(x - y)")).alias("tv"), F.sum(F.expr("x * x + y * y")).alias("q"), F.avg(F.expr("x * y")).alias("xy"), F.avg(F.expr("(x + y) / 2")).alias("half"), F.avg(F.expr("(x * x + y * y) / 2")).alias("sq"),
    )
    t = t.select(F.expr("e").alias("dirichlet_energy"), F.expr("tv").alias("total_variation"), F.expr("e / (2 * q)").alias("dirichlet_share"), F.expr("1 - e / (2 * q)").alias("smoothness_ratio"), F.expr("(xy - half * half) / (sq - half * half)").alias("assortativity"))
    return _named(t, t.columns)


def neighbor_aggregate(g: Graph, signal: DataFrame, value: str = "value") -> DataFrame:
    """(v, sum, mean, max, min) of the neighbours' numbers; an isolated vertex has 0, 0, minus and plus infinity."""
    n = g.slots.join(signal.select(F.col("v").alias("u"), F.col(value).cast("double").alias("x")), "u").groupBy("v").agg(F.sum("x").alias("sum"), F.avg("x").alias("mean"), F.max("x").alias("max"), F.min("x").alias("min"))
    return g.vertices.select("v").join(n, "v", "left").select("v", real(F.coalesce("sum", F.lit(0.0))).alias("sum"), real(F.coalesce("mean", F.lit(0.0))).alias("mean"), real(F.coalesce("max", F.lit(float("-inf")))).alias("max"), real(F.coalesce("min", F.lit(float("inf")))).alias("min"))


def symmetric_diffuse(g: Graph, signal: DataFrame, value: str = "value") -> DataFrame:
    """(v, value): one step of D^-1/2 A D^-1/2; isolated vertices get 0."""
    d = g.degrees()
    x = g.slots.join(signal.select(F.col("v").alias("u"), F.col(value).alias("x")), "u").join(d.select(F.col("v").alias("u"), F.col("d").alias("du")), "u").join(d, "v")
    return x.groupBy("v").agg(real(F.sum(F.expr("x / sqrt(du * 1.0D * d)"))).alias("value"))


def compare_communities(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, value): variation of information, normalized mutual information, Rand and adjusted Rand index, split-join distance of two labellings (v, label)."""
    both = a.select("v", F.col("label").alias("x")).join(b.select("v", F.col("label").alias("y")), "v").groupBy("x", "y").agg(F.count("*").cast("double").alias("k"))
    rows, cols = both.groupBy("x").agg(F.sum("k").alias("kx"), F.max("k").alias("mx")), both.groupBy("y").agg(F.sum("k").alias("ky"), F.max("k").alias("my"))
    joint = both.join(rows, "x").join(cols, "y")
    n = both.agg(F.sum("k").alias("n"), F.lit(1).alias("one"))
    one = lambda df: df.withColumn("one", F.lit(1))
    t = n.join(one(joint.agg(F.sum(F.expr("k * ln(k / (kx * ky))")).alias("mi"), F.sum(F.expr("k * (k - 1) / 2")).alias("pairs"))), "one")
    t = t.join(one(rows.agg(F.sum(F.expr("kx * ln(kx)")).alias("hx"), F.sum(F.expr("kx * (kx - 1) / 2")).alias("px"), F.sum("mx").alias("sx"))), "one")
    t = t.join(one(cols.agg(F.sum(F.expr("ky * ln(ky)")).alias("hy"), F.sum(F.expr("ky * (ky - 1) / 2")).alias("py"), F.sum("my").alias("sy"))), "one")
    t = t.selectExpr("n", "mi / n + ln(n) as i", "ln(n) - hx / n as hx", "ln(n) - hy / n as hy", "pairs", "px", "py", "n * (n - 1) / 2 as p", "sx", "sy")
    t = t.selectExpr("hx + hy - 2 * i as vi", "case when hx + hy = 0 then 1 else 2 * i / (hx + hy) end as nmi", "(p + 2 * pairs - px - py) / p as rand", "(pairs - px * py / p) / ((px + py) / 2 - px * py / p) as adjusted_rand", "2 * n - sx - sy as split_join")
    return _named(t, t.columns)

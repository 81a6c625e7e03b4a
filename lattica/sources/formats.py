"""Graph files as text: readers give a Graph (or named edges), writers give one line a row, to be written with DataFrame.write.text.

All are line by line, so a file of any size is read in parallel; order matters only within a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.graph import Graph


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line != ''")


def _vertices(spark: SparkSession, n: int | None, edges: DataFrame) -> DataFrame:
    if n is None:
        n = (edges.agg(F.max(F.greatest("src", "dst"))).first()[0] or -1) + 1
    return spark.range(n).select(F.col("id").alias("v"))


def read_edgelist(spark: SparkSession, path: str, n: int | None = None, directed: bool = False) -> Graph:
    """``src dst`` lines, ids from 0; # starts a comment."""
    t = F.split("line", r"\s+")
    e = _lines(spark, path).where("line not like '#%'").select(t[0].cast("long").alias("src"), t[1].cast("long").alias("dst"))
    return Graph.from_edges(e, directed, _vertices(spark, n, e))


def write_edgelist(g: Graph) -> DataFrame:
    return g.edges.select(F.concat_ws(" ", "src", "dst").alias("value"))


def _numbered(named: DataFrame, directed: bool) -> Graph:
    """From (a, b, weight) with names: vertices in the order of names."""
    names = named.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    ids = names.select("name", (F.row_number().over(Window.orderBy("name")) - 1).cast("long").alias("v"))
    e = named.join(ids.select(F.col("name").alias("a"), F.col("v").alias("src")), "a").join(ids.select(F.col("name").alias("b"), F.col("v").alias("dst")), "b")
    return Graph.from_edges(e.select("src", "dst", "weight"), directed, ids.select("v", "name"))


def read_ncol(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    """``name name [weight]`` lines."""
    t = F.split("line", r"\s+")
    return _numbered(_lines(spark, path).select(t[0].alias("a"), t[1].alias("b"), F.coalesce(F.get(t, F.lit(2)).cast("double"), F.lit(1.0)).alias("weight")), directed)


def _names(g: Graph) -> DataFrame:
    named = g.vertices if "name" in g.vertices.columns else g.vertices.withColumn("name", F.col("v").cast("string"))
    e = g.edges.join(named.select(F.col("v").alias("src"), F.col("name").alias("a")), "src").join(named.select(F.col("v").alias("dst"), F.col("name").alias("b")), "dst")
    return e if "weight" in e.columns else e.withColumn("weight", F.lit(1.0))


def write_ncol(g: Graph) -> DataFrame:
    return _names(g).select(F.concat_ws(" ", "a", "b", "weight").alias("value"))


def read_lgl(text: DataFrame, directed: bool = False) -> Graph:
    """From (block) rows split at ``#``: a name, then a line for each neighbour with an optional weight."""
    parts = text.select(F.split(F.trim("block"), r"\n").alias("l")).select(F.trim(F.col("l")[0]).alias("a"), F.explode(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))).alias("x")).where("trim(x) != ''")
    t = F.split(F.trim("x"), r"\s+")
    return _numbered(parts.select("a", t[0].alias("b"), F.coalesce(F.get(t, F.lit(1)).cast("double"), F.lit(1.0)).alias("weight")), directed)


def read_lgl_file(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    return read_lgl(spark.read.text(path, lineSep="#").select(F.col("value").alias("block")).where("trim(block) != ''"), directed)


def write_lgl(g: Graph) -> DataFrame:
    e = _names(g).groupBy("a").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "b", "weight"))), "\n").alias("x"))
    return e.select(F.concat(F.lit("# "), "a", F.lit("\n"), "x").alias("value"))


def read_dimacs(spark: SparkSession, path: str) -> tuple[Graph, int | None, int | None]:
    """A flow problem (``p max``, ``n s``, ``n t``, ``a from to capacity``) or a graph (``p edge``, ``e from to``), ids from 1: graph, source, target."""
    t = _lines(spark, path).select(F.split("line", r"\s+").alias("t"))
    head = t.where("t[0] = 'p'").first().t
    ends = {r.t[2]: int(r.t[1]) - 1 for r in t.where("t[0] = 'n' and size(t) > 2").collect()}
    e = t.where("t[0] in ('a', 'e')").select((F.col("t")[1].cast("long") - 1).alias("src"), (F.col("t")[2].cast("long") - 1).alias("dst"), F.coalesce(F.get("t", F.lit(3)).cast("double"), F.lit(1.0)).alias("weight"))
    return Graph.from_edges(e, head[1] == "max", spark.range(int(head[2])).select(F.col("id").alias("v"))), ends.get("s"), ends.get("t")


def write_dimacs(g: Graph, source: int, target: int, weight: str = "weight") -> DataFrame:
    n, m = g.vertices.count(), g.edges.count()
    head = g.spark.createDataFrame([(f"p max {n} {m}",), (f"n {source + 1} s",), (f"n {target + 1} t",)], "value string")
    return head.unionByName(g.edges.select(F.concat_ws(" ", F.lit("a"), F.col("src") + 1, F.col("dst") + 1, weight).alias("value")))


def read_pajek(spark: SparkSession, path: str) -> Graph:
    """``*Vertices n`` and ``*Edges`` or ``*Arcs`` sections, ids from 1. The section of a line is told by its kind: vertex lines are quoted or single numbers."""
    t = spark.read.text(path, wholetext=True).select(F.lower("value").alias("x"))
    n = int(t.select(F.regexp_extract("x", r"\*vertices\s+(\d+)", 1)).first()[0])
    found = None
    for kind in ("edges", "arcs"):
        part = t.select(F.explode(F.split(F.regexp_extract("x", rf"\*{kind}[^\n]*\n([^*]*)", 1), r"\n")).alias("line")).select(F.split(F.trim("line"), r"\s+").alias("t")).where("size(t) > 1")
        e = part.select((F.col("t")[0].cast("long") - 1).alias("src"), (F.col("t")[1].cast("long") - 1).alias("dst"), F.coalesce(F.get("t", F.lit(2)).cast("double"), F.lit(1.0)).alias("weight"), F.lit(kind == "arcs").alias("arc"))
        found = e if found is None else found.unionByName(e)
    directed = not found.where("arc").isEmpty()
    both = found.where("arc" if directed else "true").drop("arc")
    if directed:
        plain = found.where("not arc").drop("arc")
        both = both.unionByName(plain).unionByName(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return Graph.from_edges(both, directed, spark.range(n).select(F.col("id").alias("v")))


def _framed(g: Graph, head: list[str], body: DataFrame, tail: list[str]) -> DataFrame:
    """Lines in order: (part, at, value) sorted, so a writer with one file keeps the frame."""
    rows = [(0, i, x) for i, x in enumerate(head)] + [(9, i, x) for i, x in enumerate(tail)]
    return g.spark.createDataFrame(rows, "part int, at long, value string").unionByName(body).orderBy("part", "at").select("value")


def write_pajek(g: Graph) -> DataFrame:
    names = g.vertices.select(F.lit(1).alias("part"), F.col("v").alias("at"), F.format_string('%d "%d"', F.col("v") + 1, "v").alias("value"))
    mark = g.spark.createDataFrame([(2, 0, "*Arcs" if g.directed else "*Edges")], "part int, at long, value string")
    e = g.edges.select(F.lit(3).alias("part"), F.col("eid").alias("at"), F.format_string("%d %d", F.col("src") + 1, F.col("dst") + 1).alias("value"))
    return _framed(g, [f"*Vertices {g.vertices.count()}"], names.unionByName(mark).unionByName(e), [])


def read_graphml(spark: SparkSession, path: str) -> Graph:
    """Nodes and edges of a GraphML file; node ids are names."""
    t = spark.read.text(path, lineSep=">").select("value")
    nodes = t.where(r"value rlike '<node\\s'").select(F.regexp_extract("value", r"""\bid\s*=\s*["']([^"']*)""", 1).alias("name"))
    pair = lambda k: F.regexp_extract("value", rf"""\b{k}\s*=\s*["']([^"']*)""", 1)
    e = t.where(r"value rlike '<edge\\s'").select(pair("source").alias("a"), pair("target").alias("b"))
    directed = not t.where("value rlike 'edgedefault\\\\s*=\\\\s*[\"\\']directed'").isEmpty()
    ids = nodes.distinct().select("name", (F.row_number().over(Window.orderBy("name")) - 1).cast("long").alias("v"))
    e = e.join(ids.select(F.col("name").alias("a"), F.col("v").alias("src")), "a").join(ids.select(F.col("name").alias("b"), F.col("v").alias("dst")), "b")
    return Graph.from_edges(e.select("src", "dst"), directed, ids.select("v", "name"))


def write_graphml(g: Graph) -> DataFrame:
    body = g.vertices.select(F.lit(1).alias("part"), F.col("v").alias("at"), F.format_string('<node id="n%d"/>', "v").alias("value"))
    body = body.unionByName(g.edges.select(F.lit(2).alias("part"), F.col("eid").alias("at"), F.format_string('<edge source="n%d" target="n%d"/>', "src", "dst").alias("value")))
    kind = "directed" if g.directed else "undirected"
    return _framed(g, ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', f'<graph id="G" edgedefault="{kind}">'], body, ["</graph>", "</graphml>"])


def read_gml(spark: SparkSession, path: str) -> Graph:
    """Nodes and edges of a GML file; node ids are names."""
    t = spark.read.text(path, lineSep="]").select("value")
    number = lambda k: F.regexp_extract("value", rf"\b{k}\s+(-?\d+)", 1)
    nodes = t.where(r"value rlike '\\bnode\\s*\\['").select(number("id").alias("name"))
    e = t.where(r"value rlike '\\bedge\\s*\\['").select(number("source").alias("a"), number("target").alias("b"))
    directed = not t.where(r"value rlike '\\bdirected\\s+1'").isEmpty()
    ids = nodes.distinct().select("name", (F.row_number().over(Window.orderBy(F.col("name").cast("long"))) - 1).cast("long").alias("v"))
    e = e.join(ids.select(F.col("name").alias("a"), F.col("v").alias("src")), "a").join(ids.select(F.col("name").alias("b"), F.col("v").alias("dst")), "b")
    return Graph.from_edges(e.select("src", "dst"), directed, ids.select("v", "name"))


def write_gml(g: Graph) -> DataFrame:
    body = g.vertices.select(F.lit(1).alias("part"), F.col("v").alias("at"), F.format_string("node [ id %d ]", "v").alias("value"))
    body = body.unionByName(g.edges.select(F.lit(2).alias("part"), F.col("eid").alias("at"), F.format_string("edge [ source %d target %d ]", "src", "dst").alias("value")))
    return _framed(g, ["graph [", f"directed {int(g.directed)}"], body, ["]"])


def write_dot(g: Graph) -> DataFrame:
    body = g.vertices.select(F.lit(1).alias("part"), F.col("v").alias("at"), F.format_string("%d;", "v").alias("value"))
    body = body.unionByName(g.edges.select(F.lit(2).alias("part"), F.col("eid").alias("at"), F.concat_ws(" -> " if g.directed else " -- ", "src", F.concat(F.col("dst").cast("string"), F.lit(";"))).alias("value")))
    return _framed(g, ["digraph {" if g.directed else "graph {"], body, ["}"])


def write_leda(g: Graph) -> DataFrame:
    body = g.vertices.select(F.lit(2).alias("part"), F.col("v").alias("at"), F.lit("|{}|").alias("value"))
    mark = g.spark.createDataFrame([(3, 0, str(g.edges.count()))], "part int, at long, value string")
    e = g.edges.select(F.lit(4).alias("part"), F.col("eid").alias("at"), F.format_string("%d %d 0 |{}|", F.col("src") + 1, F.col("dst") + 1).alias("value"))
    return _framed(g, ["LEDA.GRAPH", "void", "void", "-1" if g.directed else "-2", str(g.vertices.count())], body.unionByName(mark).unionByName(e), [])


def read_dl(spark: SparkSession, path: str, directed: bool = True) -> Graph:
    """UCINET DL with ``format=edgelist1``: ``n = k`` in the head, ids from 1 after ``data:``."""
    t = spark.read.text(path, wholetext=True).select("value")
    n = int(t.select(F.regexp_extract(F.lower("value"), r"\bn\s*=\s*(\d+)", 1)).first()[0])
    lines = t.select(F.explode(F.split(F.regexp_extract("value", r"(?is)data:\s*\n(.*)", 1), r"\n")).alias("l")).select(F.split(F.trim("l"), r"\s+").alias("t")).where("size(t) > 1")
    e = lines.select((F.col("t")[0].cast("long") - 1).alias("src"), (F.col("t")[1].cast("long") - 1).alias("dst"), F.coalesce(F.get("t", F.lit(2)).cast("double"), F.lit(1.0)).alias("weight"))
    return Graph.from_edges(e, directed, spark.range(n).select(F.col("id").alias("v")))


#: Reader by extension.
READERS = {"edges": read_edgelist, "txt": read_edgelist, "ncol": read_ncol, "lgl": read_lgl_file, "net": read_pajek, "graphml": read_graphml, "gml": read_gml, "dl": read_dl}


def read_graph(spark: SparkSession, path: str, **options) -> Graph:
    """By the file's extension."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        raise ValueError(f"no reader for .{kind}")
    return READERS[kind](spark, path, **options)

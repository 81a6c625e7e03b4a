"""A graph as two DataFrames."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def real(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def store(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder that spark.checkpoint.dir names, and read back: cuts lineage.

    A local session without that setting gets a folder of its own; on a cluster the setting is needed.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark.sparkContext, "_lattica_folder", None)
        if base is None:
            base = spark.sparkContext._lattica_folder = tempfile.mkdtemp(prefix="lattica-graph-")
    path = f"{base.rstrip('/')}/graph/{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Graph:
    """``vertices`` (v, ...) and ``edges`` (eid, src, dst, ...); loops and parallel edges are allowed.

    Undirected edges are stored with src <= dst. Vertices are needed: isolated ones count.
    """

    vertices: DataFrame
    edges: DataFrame
    directed: bool = False

    @classmethod
    def from_edges(cls, edges: DataFrame, directed: bool = False, vertices: DataFrame | None = None) -> Graph:
        """From (src, dst, ...); edges without ``eid`` are numbered and written, so that every read has the same numbers. Vertices default to those on edges."""
        if not directed:
            edges = edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
        if "eid" not in edges.columns:
            edges = store(edges.withColumn("eid", F.monotonically_increasing_id()))
        if vertices is None:
            vertices = edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
        return cls(vertices, edges, directed)

    @classmethod
    def from_lists(cls, spark: SparkSession, n: int, pairs: list[tuple], directed: bool = False, weights: list[float] | None = None) -> Graph:
        """n vertices 0.., edges in the order of their ids."""
        rows = [(i, int(a), int(b), *([float(weights[i])] if weights else [])) for i, (a, b) in enumerate(pairs)]
        edges = spark.createDataFrame(rows, "eid long, src long, dst long" + (", weight double" if weights else ""))
        return cls.from_edges(edges, directed, spark.range(n).select(F.col("id").alias("v")))

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    def as_mode(self, mode: str = "out") -> Graph:
        """The graph whose slots go along edges (out), against them (in) or both ways (all); an undirected graph is the same in every mode."""
        if not self.directed or mode == "out":
            return self
        if mode == "in":
            rest = [c for c in self.edges.columns if c not in ("src", "dst")]
            return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest), True)
        return Graph.from_edges(self.edges, False, self.vertices)

    def with_edges(self, edges: DataFrame, directed: bool | None = None) -> Graph:
        return Graph.from_edges(edges, self.directed if directed is None else directed, self.vertices)

    @cached_property
    def slots(self) -> DataFrame:
        """(v, u, eid, ...): the neighbour slots; both ways if undirected (a loop twice), src to dst if directed."""
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        out = self.edges.select(F.col("src").alias("v"), F.col("dst").alias("u"), *rest)
        return out if self.directed else out.unionByName(self.edges.select(F.col("dst").alias("v"), F.col("src").alias("u"), *rest))

    @cached_property
    def both(self) -> DataFrame:
        """(v, u, eid, ...): every edge from each of its ends, whatever its direction."""
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        out = self.edges.select(F.col("src").alias("v"), F.col("dst").alias("u"), *rest)
        return out.unionByName(self.edges.select(F.col("dst").alias("v"), F.col("src").alias("u"), *rest))

    @cached_property
    def simple_slots(self) -> DataFrame:
        """(v, u): distinct neighbours, loops dropped."""
        return self.slots.where("v != u").select("v", "u").distinct()

    def degrees(self, mode: str = "all") -> DataFrame:
        """(v, d) with zeros; a loop counts twice in mode all."""
        ends = {"all": F.array("src", "dst"), "out": F.array("src"), "in": F.array("dst")}["all" if not self.directed else mode]
        counted = self.edges.select(F.explode(ends).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
        return self.vertices.select("v").join(counted, "v", "left").select("v", F.coalesce("d", F.lit(0)).cast("long").alias("d"))

    def strength(self, weight: str = "weight", mode: str = "all") -> DataFrame:
        """(v, strength): the weights at each vertex."""
        ends = {"all": F.array("src", "dst"), "out": F.array("src"), "in": F.array("dst")}["all" if not self.directed else mode]
        summed = self.edges.select(F.explode(ends).alias("v"), weight).groupBy("v").agg(F.sum(weight).alias("s"))
        return self.vertices.select("v").join(summed, "v", "left").select("v", F.coalesce("s", F.lit(0.0)).cast("double").alias("strength"))

    @cached_property
    def edge_degrees(self) -> DataFrame:
        """(eid, src, dst, du, dv) with degrees as doubles; parallel edges and loops included."""
        d = self.degrees().select("v", F.col("d").cast("double").alias("d"))
        ends = self.edges.select("eid", "src", "dst")
        ends = ends.join(d.select(F.col("v").alias("src"), F.col("d").alias("du")), "src")
        return ends.join(d.select(F.col("v").alias("dst"), F.col("d").alias("dv")), "dst").select("eid", "src", "dst", "du", "dv")

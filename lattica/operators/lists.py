"""Neighbour lists of a graph's vertices, packed, and what tasks that hold two blocks of vertices read from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.graph import Graph, store
from lattica.shipping import ship

#: Lists are merged in so many groups; edges that a worker packs together.
GROUPS, TOGETHER = 1024, 2_000_000
#: Edges between two blocks in a task of over_edges().
EDGES = 9_000_000


def numbered(g: Graph) -> DataFrame:
    """(v, i): vertices numbered from 0 without a gap."""
    parts = g.vertices.select("v").distinct().withColumn("part", F.pmod(F.xxhash64("v"), F.lit(1024)))
    inside = store(parts.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("v")) - 1))
    before = inside.groupBy("part").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n"))  # 1,024 rows
    return store(inside.join(F.broadcast(before.select("part", "base")), "part").select("v", (F.col("base") + F.col("k")).alias("i")))  # 1,024 rows


def block_of(v: np.ndarray, blocks: int) -> np.ndarray:
    return ((v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(blocks)


def pack(keys: np.ndarray) -> bytes:
    """Sorted numbers, as the differences' bytes by place."""
    gaps = np.diff(keys, prepend=np.int64(0))
    return pa.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(packed, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, n).T).view(np.int64).ravel())


def dealt(keys: np.ndarray, parts: np.ndarray, n_parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, its keys) for the parts that have any; keys stay in order."""
    order = np.argsort(parts.astype(np.uint16 if n_parts <= 1 << 16 else np.uint64), kind="stable")
    ends = np.cumsum(np.bincount(parts.astype(np.int64), minlength=n_parts))
    keys, start = keys[order], 0
    for k, end in enumerate(ends.tolist()):
        if end > start:
            yield k, keys[start:end]
        start = end


class Lists(NamedTuple):
    """rows (n, packed): the sorted v << 32 | u of edges v < u of the simple graph, each once and a v's all in one row.

    v and u are numbers of vertices: ids less ``low``, or those of ``numbers`` (v, i) where ids are far apart.
    """

    rows: DataFrame
    edges: int
    low: int
    numbers: DataFrame | None

    def named(self, df: DataFrame) -> DataFrame:
        """``df`` with the ids of the vertices whose numbers are in its column v."""
        rest = [c for c in df.columns if c != "v"]
        if self.numbers is None:
            return df.select((F.col("v") + self.low).alias("v"), *rest)
        return df.withColumnRenamed("v", "i").join(self.numbers, "i").select("v", *rest)

    def unnamed(self, df: DataFrame) -> DataFrame:
        """``df`` with numbers for the ids in its column v."""
        rest = [c for c in df.columns if c != "v"]
        if self.numbers is None:
            return df.where("v is not null").select((F.col("v").cast("long") - self.low).alias("v"), *rest)
        return df.join(self.numbers, "v").select(F.col("i").alias("v"), *rest)


def neighbour_lists(g: Graph) -> Lists:
    """The lists of an undirected graph, written. Its edges are read once and may come from any plan, with copies and loops; they need no eid.

    Copies are dropped here, where edges take a few bytes, so no plan need make them distinct before.
    """
    ship(g.spark)
    e = g.edges.where("src != dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    facts = g.vertices.agg(F.count("*").alias("n"), F.min(F.col("v").cast("long")).alias("low"), F.max(F.col("v").cast("long")).alias("high")).first()
    low, high, numbers = facts.low or 0, facts.high or 0, None
    if high - low >= 1 << 31 or high - low > 64 * facts.n + 1_000_000:
        numbers, low, high = numbered(g), 0, facts.n
        at = lambda end: numbers.select(F.col("v").alias(end), F.col("i").alias(f"i_{end}"))
        e = e.join(at("src"), "src").join(at("dst"), "dst").select(F.col("i_src").alias("src"), F.col("i_dst").alias("dst"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*held))
            keys = np.unique(np.minimum(a, b) << 32 | np.maximum(a, b))
            if keys[0] < 0 or max(a.max(), b.max()) > high - low:
                raise ValueError("an edge has an end that is no vertex")
            made = [(k, len(own), pack(own)) for k, own in dealt(keys, block_of(keys >> 32, GROUPS), GROUPS)]
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*made), (pa.int64(), pa.int64(), pa.binary()))], names=["part", "n", "packed"])

        for batch in batches:
            held.append([batch.column(c).to_numpy() - low for c in ("src", "dst")])
            n += batch.num_rows
            if n >= TOGETHER:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([unpack(p.as_py(), n) for n, p in zip(table["n"].to_pylist(), table["packed"])]))
        return pa.table({"n": [len(keys)], "packed": [pack(keys)]})

    rows = store(e.mapInArrow(send, "part long, n long, packed binary").groupBy("part").applyInArrow(merge, "n long, packed binary"))
    return Lists(rows, rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("m")).first().m, low, numbers)


def over_edges(lists: Lists, values: DataFrame, run: Callable[..., pa.Table], schema: str) -> DataFrame:
    """What ``run(v, x, a, b)`` gives for the edges between two blocks of vertices, each edge in one task.

    values: (v, whole numbers...), v being numbers. v: numbers of the blocks' vertices, sorted; x: their values, an
    array a column; a and b: the places in v of the edges' ends. Edges are sent once and values the blocks times.
    """
    blocks = 1
    while blocks * blocks * EDGES < lists.edges:
        blocks += 1
    columns = [c for c in values.columns if c != "v"]
    schema_out = pa.schema([("task", pa.int64()), ("edges", pa.bool_()), ("n", pa.int64()), ("packed", pa.list_(pa.binary()))])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), schema_out.types)], schema=schema_out)

    def send_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, packed in zip(batch["n"].to_pylist(), batch["packed"]):
                keys = unpack(packed.as_py(), n)
                task = block_of(keys >> 32, blocks) * np.uint64(blocks) + block_of(keys & 0xFFFFFFFF, blocks)
                yield made([(k, True, len(own), [pack(own)]) for k, own in dealt(keys, task, blocks * blocks)])

    def send_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch["v"].to_numpy()
            order = np.argsort(v)
            for k, own in dealt(order, block_of(v[order], blocks), blocks):
                packed = [pack(v[own]), *[pack(batch[c].to_numpy()[own]) for c in columns]]
                yield made([(t, False, len(own), packed) for t in sorted({k * blocks + j for j in range(blocks)} | {j * blocks + k for j in range(blocks)})])

    def count(key: tuple, table: pa.Table) -> pa.Table:
        keys, xs = [], []
        for edges, n, packed in zip(table["edges"].to_pylist(), table["n"].to_pylist(), table["packed"]):
            (keys if edges else xs).append([unpack(p.as_py(), n) for p in packed.values])
        if not keys:
            return run(np.zeros(0, np.int64), [np.zeros(0, np.int64)] * len(columns), np.zeros(0, np.int64), np.zeros(0, np.int64))
        v, *x = (np.concatenate(part) for part in zip(*xs))
        order = np.argsort(v)
        v = v[order]
        keys = np.concatenate([k[0] for k in keys])
        a, b = np.searchsorted(v, keys >> 32), np.searchsorted(v, keys & 0xFFFFFFFF)
        return run(v, [c[order] for c in x], a, b)

    spec = "task long, edges boolean, n long, packed array<binary>"
    values = values.select(F.col("v").cast("long").alias("v"), *[F.col(c).cast("long").alias(c) for c in columns])
    return lists.rows.mapInArrow(send_edges, spec).unionAll(values.mapInArrow(send_values, spec)).groupBy("task").applyInArrow(count, schema)

"""Near-duplicate vectors by a forest of random-projection trees with spill (Dasgupta and Sinha, 2013)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import materialize, ship, tidied
from lattica.llm.components import connected_components

#: Bits of a leaf's number in a leaf code; the tree's number, from 1, is above them. Dense groups have the codes below.
LEAF_BITS = 24
#: Rows of a comparison at a time, and random members that a node is searched for dense groups with.
TILE, PIVOTS = 1024, 64
#: A leaf of more blocks than this has blocks of WIDER times the size, so that fewer copies of its rows are sent.
MANY_BLOCKS, WIDER = 16, 4
#: A dense group whose surroundings hold more than this many times its members isn't compared with all of them.
SURROUNDED = 3


class Tree:
    """Random splits of a sample at its medians; arrays indexed by node, children as positions, leaves as negative numbers."""

    def __init__(self, sample: np.ndarray, leaf: int, spill: float, rng: np.random.Generator):
        self.normals, self.cuts, self.children, self.leaves = [], [], [], 0
        self._grow(sample, leaf, spill, rng)
        self.normals = np.array(self.normals, np.float32).reshape(-1, sample.shape[1])
        self.cuts = np.array(self.cuts, np.float32).reshape(-1, 2)

    def _grow(self, rows: np.ndarray, leaf: int, spill: float, rng: np.random.Generator) -> int:
        if len(rows) > leaf:
            normal = rng.standard_normal(rows.shape[1]).astype(np.float32)
            at = rows @ (normal / np.linalg.norm(normal))
            low, middle, high = np.quantile(at, [0.5 - spill, 0.5, 0.5 + spill])
            left, right = rows[at <= middle], rows[at > middle]
            if len(left) and len(right):
                k = len(self.cuts)
                self.normals.append(normal / np.linalg.norm(normal))
                self.cuts.append((low, high))
                self.children.append([0, 0])
                self.children[k] = [self._grow(left, leaf, spill, rng), self._grow(right, leaf, spill, rng)]
                return k
        self.leaves += 1
        return -self.leaves

    def find(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs: a row within the spill of a cut goes both ways."""
        if not len(rows):
            return np.zeros(0, int), np.zeros(0, int)
        todo, rows_out, leaves_out = [(0 if len(self.cuts) else -1, np.arange(len(rows)))], [], []
        while todo:
            node, at = todo.pop()
            if node < 0:
                rows_out.append(at)
                leaves_out.append(np.full(len(at), -node - 1))
                continue
            if len(at):
                x = rows[at] @ self.normals[node]
                todo.append((self.children[node][0], at[x <= self.cuts[node][1]]))
                todo.append((self.children[node][1], at[x >= self.cuts[node][0]]))
        return np.concatenate(rows_out), np.concatenate(leaves_out)


def grow_forest(sample: np.ndarray, rows: int, trees: int, leaf: int, spill: float, seed: int) -> list[Tree]:
    """Trees whose leaves have about ``leaf`` of ``rows`` rows, or 16 rows of the sample if that is more."""
    inside = max(16, int(leaf * len(sample) / max(1, rows)))
    return [Tree(sample, inside, spill, np.random.Generator(np.random.PCG64([seed, t]))) for t in range(trees)]


def _vectors(column: pa.Array, dims: int, kind: str) -> np.ndarray:
    out = np.zeros((len(column), dims))
    for i, x in enumerate(column):
        v = np.frombuffer(x.as_py(), kind)
        out[i, : len(v)] = v
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class DenseGroups:
    """Balls around the centres of groups with more than ``inside`` linked members in a sample; such groups don't fit in a leaf.

    A ball has the vectors with a cosine of at least ``least`` to its centre. What links with one of
    them is within twice that angle of the centre, so comparing all rows there finds every link of the
    ball: a closed group, whose members no tree need see. Where so much else is there that this would be
    far more work than the group's own pairs, the group is open: its ball is compared, and its
    members go to the trees too.
    """

    def __init__(self, sample: np.ndarray, inside: int, least: float, rng: np.random.Generator):
        self.least, self.reach = least, max(-1.0, 2 * least * least - 1) if least > 0 else -1.0
        free, centres, closed, todo = np.ones(len(sample), bool), [], [], [np.arange(len(sample))]
        while todo:
            node = todo.pop()
            node = node[free[node]]
            while len(node) > inside:
                rows = sample[node]
                near = rows @ rows[rng.choice(len(node), min(PIVOTS, len(node)), replace=False)].T >= least
                best = near.sum(0).argmax()
                if near[:, best].sum() <= inside:
                    break
                centre = rows[near[:, best]].mean(0)
                for _ in range(3):
                    centre = centre / np.linalg.norm(centre)
                    held = rows @ centre >= least
                    centre = rows[held].mean(0) if held.any() else centre
                centre = centre / np.linalg.norm(centre)
                cosines = sample @ centre
                ball = cosines >= least
                free[node[near[:, best]]] = False  # at least these are done with, so the search ends
                free[ball] = False
                centres.append(centre)
                closed.append((cosines >= self.reach).sum() <= SURROUNDED * ball.sum())
                node = node[free[node]]
            if len(node) > inside:
                at = sample[node] @ rng.standard_normal(sample.shape[1]).astype(np.float32)
                left = at <= np.median(at)
                if not left.all():
                    todo += [node[left], node[~left]]
        self.centres = np.array(centres, np.float32).reshape(-1, sample.shape[1])
        self.closed = np.array(closed, bool)

    def find(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, group) pairs to compare, and which rows the trees need: those outside the balls of closed groups."""
        cosines = rows @ self.centres.T
        at, group = np.nonzero(cosines >= np.where(self.closed, self.reach - 1e-5, self.least))
        return at, group, ~((cosines >= self.least) & self.closed).any(1)


def compare(ids: np.ndarray, sizes: np.ndarray, unit: np.ndarray, dims: np.ndarray, first: np.ndarray, codes: list[np.ndarray], code: int, least: float, alone: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links among the rows of a leaf, or of two blocks of it: (weight of links by row, a spanning forest as id pairs).

    A pair counts in the smallest code of the leaves that it shares, so no pair counts twice. Of two
    blocks (``alone`` false) only pairs across them are looked at; ``first`` marks the rows of one.
    """
    across = np.arange(len(ids)) if alone else np.flatnonzero(~first)
    down = across if alone else np.flatnonzero(first)
    earlier = [c[c < code] for c in codes]
    seen, where = np.unique(np.concatenate(earlier), return_inverse=True) if earlier else (np.zeros(0), np.zeros(0, int))
    ends = np.cumsum([0, *[len(c) for c in earlier]])

    def held(rows: np.ndarray) -> np.ndarray:
        has = np.zeros((len(rows), len(seen)), np.float32)
        for x, i in enumerate(rows):
            has[x, where[ends[i] : ends[i + 1]]] = 1
        return has

    weights, group, forest, others = np.zeros(len(ids)), np.arange(len(ids)), [], None
    for k in range(0, len(down), TILE):
        rows = down[k : k + TILE]
        linked = (unit[rows] @ unit[across].T >= least) & (dims[rows][:, None] == dims[across])
        if alone:
            linked[np.arange(len(rows)), k + np.arange(len(rows))] = False
        if len(seen) and linked.any():
            others = held(across) if others is None else others
            linked &= held(rows) @ others.T < 0.5
        weights[rows] += linked @ sizes[across]
        if not alone:
            weights[across] += sizes[rows] @ linked
        for x in np.flatnonzero(linked.any(1)):
            i = rows[x]
            new = across[linked[x] & (group[across] != group[i])]
            if len(new):
                labels, at = np.unique(group[new], return_index=True)
                forest += [(int(ids[i]), int(ids[j])) for j in new[at]]
                group[np.isin(group, labels)] = group[i]
    return weights, forest


def near_vectors(
    table: DataFrame, least: float = 0.95, trees: int = 10, leaf: int = 256, spill: float = 0.06, sample: int = 100_000, block: int = 1024, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``table``.

    n_links: other vectors found with a cosine of at least ``least``, in double precision;
    component_id: the least vec_id reachable by links; kept: whether it is the row's own.

    Equal vectors are one class, compared once and counted as often as they occur. The trees are
    fitted on about ``sample`` distinct vectors, chosen by hash, and every vector is sent to its
    leaves in every tree. Groups of near copies that don't fit in a leaf are found in the sample first
    and compared whole, see DenseGroups: splits would separate most of their pairs. Only vectors in
    one leaf or dense group are compared. A leaf of more than ``block``
    vectors is compared block by block, a task holding two blocks at most, and gives counts and
    spanning forests, never all its pairs: a large group of near copies is bounded in memory and
    output. Links over the threshold are verified, so what the forest can miss is a link, never add.

    Vectors that are null, empty, zero or hold nulls or non-finite numbers link with nothing, nor do
    vectors of different lengths. Repeated rows are others to each other. An empty table gives no
    rows. A null vec_id names no component unless there is no other. Other columns are not read.
    """
    spark = table.sparkSession
    ship(spark)
    kind = "<f4" if dict(table.dtypes)[vector_col] == "array<float>" else "<f8"
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    usable = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [None if not ok else (np.array(v.as_py(), kind) + 0).tobytes() for v, ok in zip(batch.column(1), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["vec_id", "v"])

    rows = materialize(rows.select("vec_id", "v", usable.alias("ok")).mapInArrow(tidied(as_bytes), "vec_id long, v binary"), "vectors")
    classes = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"))
    classes = materialize(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    n, dims = classes.agg(F.count("*"), F.max(F.length("v"))).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dims //= int(kind[2])
    share = int(min(1.0, sample / n) * (1 << 30))
    picked = classes.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < share).select("v").toArrow()
    fitted = _unit(_vectors(picked.column(0), dims, kind)).astype(np.float32) if picked.num_rows else np.zeros((0, dims), np.float32)
    fitted = fitted[np.lexsort(fitted.T)]
    dense = DenseGroups(fitted, max(16, int(leaf * len(fitted) / n)), least, np.random.Generator(np.random.PCG64([seed, trees])))
    rest = fitted[dense.find(fitted)[2]]
    grown = grow_forest(rest, max(1, round(n * len(rest) / max(1, len(fitted)))), trees, leaf, spill, seed)
    forest = spark.sparkContext.broadcast((dense, grown))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                some = batch.slice(k, 2000)
                unit = _unit(_vectors(some.column(1), dims, kind)).astype(np.float32)
                at, group, loose = forest.value[0].find(unit)
                loose = np.flatnonzero(loose)
                found = [tree.find(unit[loose]) for tree in forest.value[1]]
                at = np.concatenate([at, *[loose[r] for r, _ in found]])
                code = np.concatenate([group, *[x + ((t + 1) << LEAF_BITS) for t, (_, x) in enumerate(found)]])
                order = np.lexsort((code, at))
                at, code = at[order], code[order].astype("<i8")
                ends = np.searchsorted(at, np.arange(some.num_rows + 1))
                held = pa.array([code[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*[some.column(i).take(pa.array(at)) for i in (0, 1, 2)], held.take(pa.array(at)), pa.array(code)], ["c", "v", "size", "codes", "code"])

    dealt = materialize(classes.select("c", "v", "size").mapInArrow(tidied(deal), "c long, v binary, size long, codes binary, code long"), "leaves")
    width = F.when(F.col("count") > MANY_BLOCKS * block, WIDER * block).otherwise(block)
    large = dealt.groupBy("code").count().where(F.col("count") > block).select("code", F.ceil(F.col("count") / width).cast("int").alias("blocks"))
    dealt = dealt.join(large, "code", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("c", "v", "size", "codes", "code", "b", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"))

    def links(key: tuple, group: pa.Table) -> pa.Table:
        code, i, j = (k.as_py() for k in key)
        table = group.combine_chunks()
        ids, sizes = table["c"].to_numpy(), table["size"].to_numpy().astype(np.float64)
        raw = table["v"].combine_chunks()
        codes = [np.frombuffer(x.as_py(), "<i8") for x in table["codes"].combine_chunks()]
        lengths = np.array([len(x.as_py()) for x in raw])
        weights, forest_links = compare(ids, sizes, _unit(_vectors(raw, dims, kind)), lengths, table["b"].to_numpy() == i, codes, code, least, i == j)
        on = np.flatnonzero(weights)
        a = [*ids[on].tolist(), *[x for x, _ in forest_links]]
        b = [*[None] * len(on), *[y for _, y in forest_links]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array([*weights[on].astype(np.int64).tolist(), *[0] * len(forest_links)], pa.int64())})

    found = materialize(dealt.groupBy("code", "i", "j").applyInArrow(links, "a long, b long, n long"), "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("n"))
    joined = connected_components(found.where("b is not null").select("a", "b"))
    known = classes.join(counts, "c", "left").join(joined, F.col("c") == F.col("node"), "left")
    known = materialize(known.select("v", "least", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "c").alias("component")), "known")
    first = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(first, "component").select("v", "n_links", "component_id")
    out = rows.join(known, "v", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

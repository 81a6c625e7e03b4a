"""Triangles, clustering, neighbour similarity, link prediction, censuses.

Neighbour lists are joined as tables; triangles are listed from each edge's end of lower degree, so a
hub's list is never paired with itself. They are counted by tasks that hold the neighbours of two blocks of vertices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph, real, store
from lattica.operators.lists import Lists, block_of, dealt, neighbour_lists, numbered, pack, unpack
from lattica.shipping import ship


def oriented(g: Graph) -> DataFrame:
    """(a, b): distinct edges without loops, from the end of lower (degree, id): at most sqrt(2m) leave a vertex."""
    e = g.simple_slots
    d = e.groupBy("v").agg(F.count("*").alias("d"))
    x = e.join(d, "v").join(d.select(F.col("v").alias("u"), F.col("d").alias("du")), "u")
    return x.where("d < du or (d = du and v < u)").select(F.col("v").alias("a"), F.col("u").alias("b"))


def list_triangles(g: Graph) -> DataFrame:
    """(a, b, c) with a < b < c, each triangle of the simple graph once."""
    e = oriented(g)
    wedges = e.join(e.select("a", F.col("b").alias("c")), "a").where("b < c")
    closed = g.simple_slots.select(F.col("v").alias("b"), F.col("u").alias("c"))
    found = wedges.join(closed, ["b", "c"]).select(F.array_sort(F.array("a", "b", "c")).alias("t"))
    return found.select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


#: Neighbour slots that a task of _supports() holds, and places it looks up or marks at once.
SLOTS, PLACES = 36_000_000, 2_000_000


def _shared(keys: np.ndarray, blocks: int, i: int, j: int) -> tuple[np.ndarray, ...]:
    """(vertices, starts, x, y, support) of a task: keys are v << 32 | u for all neighbours u of the vertices v of blocks i and j, x and y are places in ``vertices``, an edge between the blocks each.

    The neighbours of the end of more neighbours are marked, those of the other end looked up: at most about sqrt(2m) an edge.
    """
    near = (keys & 0xFFFFFFFF).astype(np.int32)
    owner = (keys >> 32).astype(np.int32)
    starts = np.flatnonzero(np.diff(owner, prepend=np.int32(-1)))
    vertices, starts = owner[starts], np.append(starts, len(keys))
    if not len(vertices):
        return vertices, starts, starts[:0], starts[:0], starts[:0]
    width = int(near.max()) + 1
    block = block_of(vertices, blocks)
    degree = np.diff(starts)
    edge = np.flatnonzero(owner > near) if i == j else np.flatnonzero(block_of(owner, blocks) == i)
    edge = edge[block_of(near[edge], blocks) == j]
    at = np.full(max(width, int(vertices[-1]) + 1), -1, np.int32)
    at[vertices] = np.arange(len(vertices), dtype=np.int32)
    x, y = at[owner[edge]], at[near[edge]]
    del owner, edge, block, at
    swap = degree[x] < degree[y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    support, work = np.zeros(len(x), np.int64), np.cumsum(degree[y])
    rows = max(1, 16 * PLACES // width)
    marks, low = np.zeros(rows * width, np.uint8), 0
    new = np.cumsum(np.diff(x, prepend=-1) != 0)  # the markers' numbers
    while low < len(x):
        done = work[low - 1] if low else 0
        high = min(np.searchsorted(work, done + PLACES, "right"), np.searchsorted(new, new[low] + rows, "left"))
        high = max(high, low + 1)
        xs, ys = x[low:high], y[low:high]
        row = (new[low:high] - new[low]).astype(np.int64)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        marker = xs[first]
        n = degree[marker]
        put = np.repeat(starts[marker] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        put = near[put] + np.repeat(row[first] * width, n)
        marks[put] = 1
        n = degree[ys]
        ahead = np.cumsum(n) - n
        get = np.repeat(starts[ys] - ahead, n) + np.arange(n.sum())
        get = near[get] + np.repeat(row * width, n)
        support[low:high] = np.add.reduceat(marks[get], ahead, dtype=np.int64)
        marks[put] = 0
        low = high
    return vertices, starts, x, y, support


def _supports(g: Graph) -> DataFrame:
    """(a, b, support) for each edge a < b of the simple graph, for undirected graphs.

    Vertices are dealt into blocks, and a task has the neighbours of two blocks' vertices: so no pair of edges is ever written,
    and what is sent is the edges times the blocks, packed. Blocks grow with the square root of the edges' growth in tasks.
    """
    ship(g.spark)
    e = g.edges.where("src != dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    facts = e.agg(F.count("*").alias("m"), F.min(F.least("src", "dst")).alias("low"), F.max(F.greatest("src", "dst")).alias("high")).first()
    low, numbers = facts.low or 0, None
    if (facts.high or 0) - low >= 1 << 31 or (facts.high or 0) - low > 64 * facts.m + 1_000_000:
        numbers, low = numbered(g), 0
        at = lambda end: numbers.select(F.col("v").alias(end), F.col("i").alias(f"i_{end}"))
        e = e.join(at("src"), "src").join(at("dst"), "dst").select(F.col("i_src").alias("src"), F.col("i_dst").alias("dst"))
    blocks = max(1, -(-4 * facts.m // SLOTS))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            a, b = (np.concatenate(x) for x in zip(*held))
            keys = np.concatenate([a << 32 | b, b << 32 | a])
            block = block_of(keys >> 32, blocks)
            for k in range(blocks):
                own = np.unique(keys[block == k])
                if len(own):
                    packed, tasks = pack(own), [min(k, j) * blocks + max(k, j) for j in range(blocks)]
                    yield pa.RecordBatch.from_arrays([pa.array(tasks, pa.int64()), pa.array([len(own)] * blocks, pa.int64()), pa.array([packed] * blocks, pa.binary())], names=["task", "n", "packed"])

        for batch in batches:
            held.append([batch.column(c).to_numpy() - low for c in ("src", "dst")])
            n += batch.num_rows
            if n >= 2_000_000:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    def count(key: tuple, table: pa.Table) -> pa.Table:
        i, j = divmod(key[0].as_py(), blocks)
        keys = np.empty(sum(table["n"].to_pylist()), np.int64)
        done = 0
        for n, packed in zip(table["n"].to_pylist(), table["packed"]):
            keys[done : done + n] = unpack(packed.as_py(), n)
            done += n
        del table
        keys.sort()
        if len(keys) > 1:
            once = np.append(True, keys[1:] != keys[:-1])
            keys = keys if once.all() else keys[once]
        vertices, starts, x, y, support = _shared(keys, blocks, i, j)
        del keys
        names = vertices.astype(np.int64) + low
        return pa.table({"a": np.minimum(names[x], names[y]), "b": np.maximum(names[x], names[y]), "support": support})

    found = e.mapInArrow(send, "task long, n long, packed binary").groupBy("task").applyInArrow(count, "a long, b long, support long")
    if numbers is None:
        return found
    name = lambda c: numbers.select(F.col("v").alias(f"v_{c}"), F.col("i").alias(c))
    return found.join(name("a"), "a").join(name("b"), "b").select(F.least("v_a", "v_b").alias("a"), F.greatest("v_a", "v_b").alias("b"), "support")


def _closed(vertices: np.ndarray, starts: np.ndarray, near: np.ndarray, first: np.ndarray | None) -> np.ndarray:
    """Triangles at each number, of those whose two least vertices are in the two blocks of a task, one in each.

    near[starts[k]:starts[k + 1]] are the neighbours of vertices[k] with higher numbers; first tells which are in the first block, None that there is one block.
    The list of the end with the longer one is marked, that of the other end looked up: at most about sqrt(2m) an edge.
    """
    width = int(max(near.max(), vertices.max())) + 1
    found = np.zeros(width, np.int64)
    degree = np.diff(starts)
    at = np.full(width, -1, np.int32)
    at[vertices] = np.arange(len(vertices), dtype=np.int32)
    ends, low = [], 0
    while low < len(vertices):
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + PLACES, "right")) - 1)
        x, y = np.repeat(np.arange(low, high, dtype=np.int32), degree[low:high]), at[near[starts[low] : starts[high]]]
        kept = y >= 0
        if first is not None:
            kept &= first[x] != first[y]
        ends.append((x[kept], y[kept]))
        low = high
    x, y = (np.concatenate(e) for e in zip(*ends))
    del at, ends
    swap = degree[x] < degree[y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    del order, swap
    work = np.cumsum(degree[y])
    rows = max(1, 16 * PLACES // width)
    marks, low = np.zeros(rows * width, np.uint8), 0
    new = np.cumsum(np.diff(x, prepend=-1) != 0, dtype=np.int32)  # the markers' numbers
    while low < len(x):
        done = work[low - 1] if low else 0
        high = min(np.searchsorted(work, done + PLACES, "right"), np.searchsorted(new, new[low] + rows, "left"))
        high = max(high, low + 1)
        xs, ys = x[low:high], y[low:high]
        row = (new[low:high] - new[low]).astype(np.int64)
        start = np.flatnonzero(np.diff(row, prepend=-1))
        marker = xs[start]
        n = degree[marker]
        put = np.repeat(starts[marker] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        put = near[put] + np.repeat(row[start] * width, n)
        marks[put] = 1
        n = degree[ys]
        ends_at = np.cumsum(n)
        third = near[np.repeat(starts[ys] - (ends_at - n), n) + np.arange(ends_at[-1])]
        hit = np.flatnonzero(marks[third + np.repeat(row * width, n)])
        edge = np.searchsorted(ends_at, hit, "right")
        for v in (third[hit], vertices[xs[edge]], vertices[ys[edge]]):
            np.add.at(found, v, 1)
        marks[put] = 0
        low = high
    return found


def at_vertices(lists: Lists) -> DataFrame:
    """(v, degree, triangles) of the simple graph, v being numbers; vertices without an edge are left out.

    Vertices are dealt into blocks, and a task has the lists of two blocks. A triangle is counted where its two least
    vertices meet, so edges are sent from one end only: half the slots, and half the blocks, of _supports().
    """
    blocks = max(1, -(-2 * lists.edges // SLOTS))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, packed in zip(batch["n"].to_pylist(), batch["packed"]):
                keys = unpack(packed.as_py(), n)
                for k, own in dealt(keys, block_of(keys >> 32, blocks), blocks):
                    tasks, again = [min(k, j) * blocks + max(k, j) for j in range(blocks)], pack(own)
                    yield pa.RecordBatch.from_arrays([pa.array(tasks, pa.int64()), pa.array([len(own)] * blocks, pa.int64()), pa.array([again] * blocks, pa.binary())], names=["task", "n", "packed"])

    def count(key: tuple, table: pa.Table) -> pa.Table:
        i, j = divmod(key[0].as_py(), blocks)
        near, vertices, degree, done = np.empty(sum(table["n"].to_pylist()), np.int32), [], [], 0
        for n, packed in zip(table["n"].to_pylist(), table["packed"]):
            keys = unpack(packed.as_py(), n)
            near[done : done + n] = keys & 0xFFFFFFFF
            done += n
            owner = keys >> 32
            start = np.flatnonzero(np.diff(owner, prepend=-1))
            vertices.append(owner[start].astype(np.int32))
            degree.append(np.diff(start, append=n))
        del table
        vertices, starts = np.concatenate(vertices), np.concatenate([[0], np.cumsum(np.concatenate(degree))])
        found = _closed(vertices, starts, near, None if i == j else block_of(vertices, blocks) == i)
        slots = np.zeros(len(found), np.int64)
        if i == j:
            slots = np.bincount(near, minlength=len(found))
            slots[vertices] += np.diff(starts)
        v = np.flatnonzero(found | slots)
        return pa.table({"v": v, "degree": slots[v], "triangles": found[v]})

    rows = lists.rows.mapInArrow(send, "task long, n long, packed binary").groupBy("task").applyInArrow(count, "v long, degree long, triangles long")
    return rows.groupBy("v").agg(F.sum("degree").alias("degree"), F.sum("triangles").alias("triangles"))


def count_adjacent_triangles(g: Graph) -> DataFrame:
    """(v, triangles), zeros included."""
    if not g.directed:
        return clustering(g).select("v", "triangles")
    at = list_triangles(g).select(F.explode(F.array("a", "b", "c")).alias("v")).groupBy("v").agg(F.count("*").alias("triangles"))
    return g.vertices.select("v").join(at, "v", "left").select("v", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"))


def clustering(g: Graph) -> DataFrame:
    """(v, degree, triangles, transitivity): of the simple graph; transitivity is null below degree 2."""
    if g.directed:
        d = g.simple_slots.groupBy("v").agg(F.count("*").alias("degree"))
        t = count_adjacent_triangles(g).join(d, "v", "left").select("v", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), "triangles")
    else:
        lists = neighbour_lists(g)
        t = g.vertices.select("v").join(lists.named(at_vertices(lists)), "v", "left").select("v", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("degree", "triangles")])
    return t.withColumn("transitivity", F.expr("case when degree >= 2 then 2.0D * triangles / (degree * (degree - 1)) end"))


def triangle_totals(g: Graph) -> DataFrame:
    """(name, value): count_triangles, transitivity_undirected, transitivity_avglocal_undirected (over degrees of 2 or more), avg_local_clustering (zeros count)."""
    t = clustering(g).agg(
        (F.sum("triangles") / 3).alias("count_triangles"), (F.sum("triangles") / F.sum(F.expr("degree * (degree - 1) / 2"))).alias("transitivity_undirected"),
        F.avg("transitivity").alias("transitivity_avglocal_undirected"), F.avg(F.coalesce("transitivity", F.lit(0.0))).alias("avg_local_clustering"),
    )
    return t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), real(c).alias("value")) for c in t.columns])).alias("p")).select("p.*")


def edge_support(g: Graph) -> DataFrame:
    """(a, b, support): triangles on each distinct edge, a < b."""
    if not g.directed:
        return _supports(g)
    t = list_triangles(g)
    on = t.select(F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("a", "b"), ("b", "c"), ("a", "c"))])).alias("e")).select("e.*").groupBy("a", "b").agg(F.count("*").alias("support"))
    pairs = g.simple_slots.select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).distinct()
    return pairs.join(on, ["a", "b"], "left").select("a", "b", F.coalesce("support", F.lit(0)).cast("long").alias("support"))


def common_neighbours(g: Graph) -> DataFrame:
    """(a, b, common, adamic_adar, resource_allocation, inverse_log) for pairs a < b with a common neighbour; simple neighbours."""
    e = g.simple_slots
    d = e.groupBy("v").agg(F.count("*").alias("d"))
    x = e.join(d, "v").select(F.col("v").alias("m"), F.col("u").alias("a"), "d")
    pairs = x.join(x.select("m", F.col("a").alias("b")), "m").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("common"), F.sum(F.expr("1 / ln(d)")).alias("adamic_adar"), F.sum(F.expr("1.0D / d")).alias("resource_allocation"))


def similarity(g: Graph) -> DataFrame:
    """(a, b, ...): every neighbour similarity of pairs with a common neighbour; other pairs have 0 in all but preferential attachment."""
    d = g.simple_slots.groupBy("v").agg(F.count("*").cast("double").alias("d"))
    p = common_neighbours(g).join(d.select(F.col("v").alias("a"), F.col("d").alias("x")), "a").join(d.select(F.col("v").alias("b"), F.col("d").alias("y")), "b")
    k = "common"
    made: dict[str, str] = {
        "similarity_jaccard": f"{k} / (x + y - {k})", "similarity_dice": f"2 * {k} / (x + y)", "similarity_inverse_log_weighted": "adamic_adar", "link_pred_common_neighbors": k, "link_pred_adamic_adar": "adamic_adar",
        "link_pred_resource_allocation": "resource_allocation", "link_pred_preferential_attachment": "x * y", "link_pred_salton": f"{k} / sqrt(x * y)", "link_pred_sorensen": f"2 * {k} / (x + y)",
        "link_pred_hub_promoted": f"{k} / least(x, y)", "link_pred_hub_depressed": f"{k} / greatest(x, y)", "link_pred_leicht_holme_newman": f"{k} / (x * y)",
    }
    return p.select("a", "b", *[real(F.expr(x).cast("double")).alias(n) for n, x in made.items()])


def cocitation(g: Graph) -> DataFrame:
    """(a, b, n): how many vertices point at both, by neighbour slots."""
    x = g.slots.select(F.col("v").alias("m"), F.col("u").alias("a"))
    return x.join(x.select("m", F.col("a").alias("b")), "m").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def bibcoupling(g: Graph) -> DataFrame:
    """(a, b, n): how many vertices both point at."""
    x = g.slots.select(F.col("u").alias("m"), F.col("v").alias("a"))
    return x.join(x.select("m", F.col("a").alias("b")), "m").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def dyad_census(g: Graph) -> DataFrame:
    """(mutual, asymmetric, none) of the simple graph."""
    pairs = g.slots.where("v != u").select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b"), (F.col("v") < F.col("u")).alias("up")).distinct().groupBy("a", "b").agg(F.count("*").alias("ways"))
    c = pairs.agg(F.count_if(F.col("ways") == 2).alias("mutual"), F.count_if(F.col("ways") == 1).alias("asymmetric")).withColumn("one", F.lit(1))
    n = g.vertices.agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    return c.join(n, "one").select(*[F.col(x).cast("double").alias(x) for x in ("mutual", "asymmetric")], F.expr("n * (n - 1) / 2.0D - mutual - asymmetric").cast("double").alias("none"))


def reciprocity(g: Graph) -> DataFrame:
    """(reciprocity): the share of edges, loops left out, whose reverse exists, copies matched one to one."""
    k = g.edges.where("src != dst").groupBy("src", "dst").agg(F.count("*").alias("k"))
    back = k.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("k").alias("b"))
    both = k.join(back, ["src", "dst"], "left").agg((F.sum(F.least("k", F.coalesce("b", F.lit(0)))) / F.sum("k")).alias("r"))
    return both.select(real("r").alias("reciprocity"))


def local_scan(g: Graph) -> DataFrame:
    """(v, local_scan): edges in the closed neighbourhood of each vertex of a simple graph: its degree and its triangles."""
    return clustering(g).select("v", (F.col("degree") + F.col("triangles")).alias("local_scan"))


def burt_constraint(g: Graph) -> DataFrame:
    """(v, constraint) of the simple graph: the sum over neighbours u of (p_vu + sum over q of p_vq p_qu) squared."""
    e = g.simple_slots
    d = e.groupBy("v").agg(F.count("*").cast("double").alias("d"))
    p = e.join(d, "v").select("v", "u", (1 / F.col("d")).alias("p"))
    two = p.join(p.select(F.col("v").alias("u"), F.col("u").alias("w"), F.col("p").alias("p2")), "u").where("v != w").groupBy("v", "w").agg(F.sum(F.col("p") * F.col("p2")).alias("p2"))
    # squared over direct neighbours only: others have no tie of their own
    all_ = p.join(two.withColumnRenamed("w", "u"), ["v", "u"], "left").select("v", F.pow(F.col("p") + F.coalesce("p2", F.lit(0.0)), 2).alias("c"))
    return all_.groupBy("v").agg(real(F.sum("c")).alias("constraint"))

"""Bounded-space online packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import materialize, ship, tidied
from lattica.llm.tokens import AT_ONCE, encoder

#: Partitions whose open windows one task merges.
FAN = 16
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.int64()), ("ids", pa.binary()),
])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open long, ids binary"


class Packer:
    """``windows`` open windows of ``capacity`` tokens; pieces go where they fit best.

    If a piece fits nowhere and no further window may open, the fullest window is emitted: first the
    head of the piece fills it up, if its gap has ``cut`` tokens or more (0: pieces are never cut).
    """

    def __init__(self, capacity: int, windows: int, cut: int, first_id: int):
        self.capacity, self.windows, self.cut, self.next_id = capacity, windows, cut, first_id
        self.open: list[tuple[int, list]] = []  # tokens, pieces (label, start, stop)
        self.closed: list[tuple[int, list]] = []

    def _emit(self, pieces: list) -> None:
        self.closed.append((self.next_id, pieces))
        self.next_id += 1

    def add(self, label, start: int, stop: int) -> None:
        while stop - start >= self.capacity:
            self._emit([(label, start, start + self.capacity)])
            start += self.capacity
        while start < stop:
            size = stop - start
            best = max((k for k, (used, _) in enumerate(self.open) if used + size <= self.capacity), key=lambda k: self.open[k][0], default=None)
            if best is not None:
                used, pieces = self.open[best]
                pieces.append((label, start, stop))
                if used + size == self.capacity:
                    self.open.pop(best)
                    self._emit(pieces)
                else:
                    self.open[best] = (used + size, pieces)
                return
            if len(self.open) < self.windows:
                self.open.append((size, [(label, start, stop)]))
                return
            used, pieces = self.open.pop(max(range(len(self.open)), key=lambda k: self.open[k][0]))
            gap = self.capacity - used
            if self.cut and gap >= self.cut:
                pieces.append((label, start, start + gap))
                start += gap
            self._emit(pieces)

    def drain(self) -> list[tuple[int, list]]:
        out, self.closed = self.closed, []
        return out

    def finish(self) -> list[tuple[int, list]]:
        for _, pieces in self.open:
            self._emit(pieces)
        self.open = []
        return self.drain()


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, windows: int = 8, cut: int = 16, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, as little-endian unsigned 32-bit bytes, if asked for).

    Every document is its ids and ``end_id``; null texts count as empty. Each id lies in one piece,
    the pieces of a sequence follow each other from offset 0 and sum to ``capacity`` at most.
    Documents longer than a window fill whole windows first. Each partition has ``windows`` open
    windows at any time, so memory doesn't grow with the input; what is open when a partition ends
    is merged, 16 partitions a task, until one task is left. Empty tables give no rows; repeated rows
    and null doc_ids are packed like others; other columns are not read.
    """
    if capacity < 1 or windows < 1:
        raise ValueError("capacity and windows must be positive")

    def rows(sequences: list, still_open: bool, texts: list) -> pa.RecordBatch:
        out = {k: [] for k in _SCHEMA.names}
        for sequence_id, pieces in sequences:
            offset = 0
            for k, start, stop in pieces:
                doc_id, ids = texts[k]
                some = ids[4 * start : 4 * stop]
                for name, x in zip(out, (doc_id, start, stop - start, zlib.crc32(some), len(ids) // 4, sequence_id, offset, int(still_open), some if with_ids else None)):
                    out[name].append(x)
                offset += stop - start
        return pa.RecordBatch.from_pydict(out, schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, end = encoder(tokenizer).groups, end_id.to_bytes(4, "little")
        packer = Packer(capacity, windows, cut, TaskContext.get().partitionId() << 36)
        texts: dict[int, tuple] = {}
        n = 0
        for batch in batches:
            doc_ids = iter(batch.column(0).to_pylist())
            for ids, ends in groups(batch.column(1)):
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    texts[n] = (next(doc_ids), ids[a:b].tobytes() + end)
                    packer.add(n, 0, b - a + 1)
                    n += 1
                yield rows(packer.drain(), False, texts)
                texts = {i: texts[i] for _, pieces in packer.open for i, _, _ in pieces}
        yield rows(packer.finish(), True, texts)

    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(picked.mapInArrow(tidied(run, 2 * AT_ONCE), _DDL), "pieces")
    return merge_open(pieces, capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def merge_open(pieces: DataFrame, capacity: int) -> DataFrame:
    """Puts the pieces of open windows together, largest first where they fit best, in rounds of ``FAN`` groups."""

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        turn, number = key[0].as_py(), key[1].as_py()
        order = sorted(range(group.num_rows), key=lambda k: (-group["length"][k].as_py(), group["doc_id"][k].as_py() or 0, group["start"][k].as_py()))
        packer = Packer(capacity, group.num_rows + 1, 0, (1 << 62) + (turn << 56) + (number << 26))
        for k in order:
            packer.add(k, 0, group["length"][k].as_py())
        full, rest = packer.drain(), sorted(packer.open, key=lambda x: -x[0])
        for _, x in rest[:-1]:  # what no other window could take is emitted, but for the emptiest
            packer._emit(x)
        full += packer.drain()
        last = [(packer.next_id, x) for _, x in rest[-1:]]
        where = {}
        for sequences, is_open in ((full, 0), (last, 1)):
            for sequence_id, x in sequences:
                offset = 0
                for k, _, size in x:
                    where[k] = (sequence_id, offset, is_open)
                    offset += size
        taken = [where[k] for k in range(group.num_rows)]
        columns = dict(zip(group.column_names, group.columns))
        columns |= {name: pa.array([x[i] for x in taken], pa.int64()) for i, name in enumerate(("sequence_id", "offset", "open"))}
        return pa.table({k: columns[k] for k in _SCHEMA.names}, schema=_SCHEMA)

    done = [pieces.where("open = 0")]
    left = pieces.where("open = 1").withColumn("group", F.shiftright("sequence_id", 36))
    turn, widest = 0, left.agg(F.max("group")).first()[0]
    while widest is not None:
        widest //= FAN
        keyed = left.select("*", F.lit(turn).cast("long").alias("turn"), F.expr(f"group div {FAN}").alias("number"))
        merged = materialize(keyed.select("turn", "number", *_SCHEMA.names).groupBy("turn", "number").applyInArrow(merge, _DDL), "merged")
        if widest == 0:
            done.append(merged)
            break
        done.append(merged.where("open = 0"))
        left = merged.where("open = 1").withColumn("group", F.expr(f"(sequence_id >> 26) & {(1 << 30) - 1}L"))
        turn += 1
    whole = done[0]
    for x in done[1:]:
        whole = whole.unionByName(x)
    return whole

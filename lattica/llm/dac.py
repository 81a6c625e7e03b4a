"""Token files of directly addressable codes (Brisaboa, Ladra and Navarro, 2013).

A file holds the ids of whole documents, document by document. Ids are split into chunks of eight
bits, low chunk first. Level 0 has the low chunk of every id; a bitmap says which ids go on, level 1
has the next chunk of those, and so on. A rank directory has the bits set before each 512-bit
stretch of a bitmap, so the place of an id's next chunk is one lookup and the count of at most 512
bits: any id is read without decoding others.

Layout, little-endian: magic, u32 levels, u64 documents, u64 ids; then sections, each at the place
that the header's table of u64 offsets gives: doc_ids (i64), their validity (u8), starts (u64,
documents + 1), and for each level chunks (u8), bitmap (u64 words) and rank directory (u64).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import fresh_path, materialize, ship, tidied
from lattica.llm.tokens import AT_ONCE, encoder

MAGIC = b"LATDAC01"
_HEAD = struct.Struct("<8sIQQ")
STRETCH = 512


def pack(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes; ``starts`` has the first id of each document and the number of ids last."""
    levels = []
    rest = ids.astype(np.uint32)
    while True:
        chunks, more = (rest & 0xFF).astype(np.uint8), rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 64, np.uint8)])
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits.view("<u8")).reshape(-1, 8).sum(1, dtype=np.uint64))]).astype("<u8")
        levels.append((chunks, bits, ranks))
        rest = rest[more] >> 8
        if not len(rest):
            break
    valid = np.array([x is not None for x in doc_ids], np.uint8)
    parts = [np.array([x or 0 for x in doc_ids], "<i8").tobytes(), valid.tobytes(), np.asarray(starts, "<u8").tobytes()]
    parts += [x.tobytes() for level in levels for x in level]
    at = _HEAD.size + 8 * (len(parts) + 1)
    offsets = at + np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return b"".join([_HEAD.pack(MAGIC, len(levels), len(doc_ids), len(ids)), offsets.astype("<u8").tobytes(), *parts])


class TokenFile:
    """Reads a file from anything that slices as bytes do: bytes, a memory map, a memoryview."""

    def __init__(self, data):
        self.data = data
        magic, self.levels, self.n_docs, self.n_tokens = _HEAD.unpack(bytes(data[: _HEAD.size]))
        if magic != MAGIC:
            raise ValueError("not a token file")
        n = 4 + 3 * self.levels
        self._at = struct.unpack(f"<{n}Q", bytes(data[_HEAD.size : _HEAD.size + 8 * n]))

    def _bytes(self, section: int, start: int, stop: int) -> bytes:
        return bytes(self.data[self._at[section] + start : self._at[section] + stop])

    def _all(self, section: int, kind: str) -> np.ndarray:
        return np.frombuffer(bytes(self.data[self._at[section] : self._at[section + 1]]), kind)

    def doc_ids(self) -> list[int | None]:
        return [int(x) if ok else None for x, ok in zip(self._all(0, "<i8"), self._all(1, "u1"))]

    def starts(self) -> np.ndarray:
        return self._all(2, "<u8").astype(np.int64)

    def token(self, i: int) -> int:
        """The id at ``i`` of the file, from a few bytes of each level that it has."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            value |= self._bytes(3 + 3 * level, i, i + 1)[0] << 8 * level
            stretch, within = divmod(i, STRETCH)
            word = int.from_bytes(self._bytes(4 + 3 * level, stretch * STRETCH // 8, stretch * STRETCH // 8 + within // 8 + 1), "little")
            if not word >> within & 1:
                return value
            before = int.from_bytes(self._bytes(5 + 3 * level, 8 * stretch, 8 * stretch + 8), "little")
            i = before + (word & (1 << within) - 1).bit_count()
        raise ValueError("the last level goes on")

    def document(self, k: int) -> list[int]:
        a, b = struct.unpack("<2Q", self._bytes(2, 8 * k, 8 * k + 16))
        return [self.token(i) for i in range(a, b)]

    def tokens(self) -> np.ndarray:
        """All ids, level by level."""
        ids = self._all(3, "u1").astype(np.uint32)
        at = np.arange(len(ids))
        for level in range(1, self.levels):
            more = np.unpackbits(self._all(1 + 3 * level, "u1"), bitorder="little")[: len(at)].astype(bool)
            at = at[more]
            ids[at] |= self._all(3 + 3 * level, "u1").astype(np.uint32) << 8 * level
        return ids


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = 2_000_000) -> DataFrame:
    """Encodes every whole text, appends ``end_id`` and writes token files to ``folder`` in ascending doc_id order.

    Returns the manifest, a written table with a row for each file: name, part, segment, n_docs,
    n_tokens, and first_token, the ids in all files before it. Files of attempts that didn't end
    are not in it. ``folder`` is a URI that Spark and pyarrow.fs both know and all machines share.

    Null texts count as empty: ``end_id`` alone. A null doc_id comes first; rows of one doc_id are in
    the order of their texts' hashes, over as many tasks as they need. An empty table gives an empty manifest. Other columns are not read.
    A file is closed at the document that brings it to ``file_tokens``, so memory is bounded by that
    and the longest document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        end = np.array([end_id], "<u4")
        part, segment = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, held, size, segment
            starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in held])])
            data = pack(doc_ids, starts, np.concatenate([x for ids in held for x in (ids, end)]))
            name = f"tokens-{part:06d}-{segment:05d}-{uuid.uuid4().hex[:8]}.dac"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            row = {"name": [name], "part": [part], "segment": [segment], "n_docs": [len(doc_ids)], "n_tokens": [int(starts[-1])]}
            doc_ids, held, size, segment = [], [], 0, segment + 1
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("name", pa.string()), ("part", pa.int64()), ("segment", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        groups = encoder(tokenizer).groups
        for batch in batches:
            batch_ids = iter(batch.column(0).to_pylist())
            for ids, ends in groups(batch.column(1)):
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    doc_ids.append(next(batch_ids))
                    held.append(ids[a:b])
                    size += b - a + 1
                    if size >= file_tokens:
                        yield flush()
        if doc_ids:
            yield flush()

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    made = materialize(ordered.mapInArrow(tidied(run, 2 * AT_ONCE), "name string, part long, segment long, n_docs long, n_tokens long"), "manifest")
    earlier = Window.orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return made.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that the manifest names.

    start: the ids of all documents before it; ids_crc32: of its ids as little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                file = TokenFile(memoryview(content.as_buffer()))
                starts, ids = file.starts(), file.tokens().astype("<u4")
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * file.n_docs), pa.array(file.doc_ids(), pa.int64()), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(sums, pa.int64())],
                    ["name", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    ship(spark)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    found = files.mapInArrow(tidied(run), "name string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(manifest.select("name", "first_token"), "name").select("doc_id", (F.col("first_token") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes token files to the shared folder and reads them back: see write_tokens and read_tokens."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    return read_tokens(spark, folder, write_tokens(docs, tokenizer, folder))

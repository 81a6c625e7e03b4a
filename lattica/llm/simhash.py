"""SimHash near-duplicates: inverted index over positional bytes, count filter, verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import materialize, ship, tidied
from lattica.llm.components import connected_components

SEED = 42
#: Fingerprints up to which postings of three bytes cost less than postings of four; both are exact.
THREE_BYTES_UP_TO = 1 << 26


def fingerprint(text: bytes | None, ngram: int = 4) -> int:
    """64 majority bits of the XXH64 values of the shingles of ``text``; 0 if it has no word."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - ngram + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    stops = ends[-n:].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[k : k + (1 << 15)], stops[k : k + (1 << 15)])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 4) -> DataFrame:
    """(doc_id long, text_hash long, fp long), one row per row of ``docs``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            fps = np.array([fingerprint(t.as_py(), ngram) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    return picked.mapInArrow(tidied(run), "doc_id long, text_hash long, fp long")


def byte_sets(size: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any four of the eight positions hold one of them.

    size 4: all 70. size 3: the 20 of Turan's construction, from three classes of positions: the
    triples in a class and those of two in a class and one in the next.
    """
    if size == 4:
        return list(combinations(range(8), 4))
    part = [0, 0, 0, 1, 1, 1, 2, 2]
    found = []
    for three in combinations(range(8), 3):
        c = [sum(part[i] == k for i in three) for k in range(3)]
        if 3 in c or any(c[k] == 2 and c[(k + 1) % 3] == 1 for k in range(3)):
            found.append(three)
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _byte_matches(a: str, b: str) -> str:
    """SQL: how many of the eight positional bytes two fingerprints share."""
    return " + ".join(f"if(({a} ^ {b}) & {_signed(0xFF << 8 * i)}L = 0, 1, 0)" for i in range(8))


def near_links(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """(fp, component): distinct fingerprints and the least fingerprint reachable by links of at most ``max_bits`` (4 at most) bits.

    Two fingerprints within four bits differ in four bytes at most, so they share four of the eight
    positional bytes. The inverted index has a posting list for each set of positional bytes, over
    sets that any four shared bytes are sure to hit; a pair met in a list is tallied over its eight
    bytes, kept from four matches on, and verified by its differing bits.

    A family of near copies never becomes all its pairs. Before the index is probed, fingerprints
    that agree but for one half byte are joined to the least of their group (16 members at most),
    which is always a link. Then lists with members of one component are dropped, and in the rest
    only members outside a list's main component are compared with the others.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("max_bits must be from 0 to 4: the count filter guarantees four shared bytes only then")
    fps = materialize(prints.select("fp").where("fp is not null").distinct(), "fps", prints.count())
    n = fps.count()
    if max_bits == 4:
        halves = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.expr(f"fp & {_signed(~(0xF << 4 * i) & (1 << 64) - 1)}L").alias("k")) for i in range(16)]))
        groups = fps.select("fp", halves.alias("h")).groupBy("h.s", "h.k").agg(F.collect_set("fp").alias("x")).where("size(x) > 1")
        sure = connected_components(groups.select(F.array_min("x").alias("a"), F.explode("x").alias("b")), rows=n)
        fps = materialize(fps.join(sure, fps.fp == sure.node, "left").select("fp", F.coalesce("component", "fp").alias("c")), "fps", n)
    else:
        fps = fps.withColumn("c", F.col("fp"))
    sets = byte_sets(3 if n <= THREE_BYTES_UP_TO else 4)
    masks = [sum(0xFF << 8 * i for i in s) for s in sets]
    lists = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.expr(f"fp & {_signed(m)}L").alias("k")) for i, m in enumerate(masks)]))
    index = fps.select("fp", "c", lists.alias("h")).select("fp", "c", "h.s", "h.k")
    mixed = index.groupBy("s", "k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("s", "k")
    index = materialize(index.join(mixed, ["s", "k"]), "postings", n * len(sets))
    main = index.groupBy("s", "k", "c").count().groupBy("s", "k").agg(F.max_by("c", F.struct("count", "c")).alias("main"))
    outside = index.join(main, ["s", "k"]).where("c != main")
    pairs = outside.alias("x").join(
        index.alias("y"),
        F.expr(
            "x.s = y.s and x.k = y.k and x.c != y.c and (y.c = x.main or x.fp < y.fp)"
            f" and {_byte_matches('x.fp', 'y.fp')} >= 4 and bit_count(x.fp ^ y.fp) <= {max_bits}"
        ),
    )
    joined = connected_components(pairs.select(F.col("x.c").alias("a"), F.col("y.c").alias("b")), rows=n)
    return fps.join(joined, fps.c == joined.node, "left").select("fp", F.coalesce("component", "c").alias("component"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``docs``: its fingerprint and the least doc_id reachable by links.

    Documents link at fingerprints that differ in at most ``max_bits`` bits; exact copies have one
    fingerprint and meet in it. Null or empty texts and those of white space have fingerprint zero,
    which links like any other. Repeated rows give repeated rows; a null doc_id keeps its row and
    never names a component unless the component has no other. An empty table gives no rows. Other
    columns of ``docs`` are not read.
    """
    prints = materialize(with_fingerprints(docs, id_col, text_col, ngram), "prints")
    known = near_links(prints, max_bits)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    known = materialize(known.join(least, "fp"), "known", prints.count())
    first = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(first, "component").select("fp", "component_id")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of ``docs`` for each group of near copies, with its columns: that of the least doc_id, null last.

    Of rows that share that doc_id, the text with the least hash stays; of rows equal in both, any one. So
    rows with one doc_id, or none, and unrelated texts are all kept. Links and the treatment of null and empty
    texts are as in simhash_groups(); an empty table stays empty.
    """
    prints = materialize(with_fingerprints(docs, id_col, text_col, ngram), "prints")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    least = prints.groupBy("fp").agg(F.min(place).alias("head"))
    heads = near_links(prints, max_bits).join(least, "fp").groupBy("component").agg(F.min("head").alias("head")).select("head.doc_id", "head.text_hash")
    heads = materialize(heads, "heads", prints.count())
    text = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("i"), text.alias("h"))
    kept = rows.join(heads, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")), "left_semi")
    if not prints.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():  # else the texts needn't move
        kept = kept.dropDuplicates(["i", "h"])
    return kept.select("row.*")

"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: One run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: One run of characters other than ASCII punctuation, capitals, controls and white space.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Rows of a narrow table that one task writes.
ROWS_A_FILE = 25_000
#: Bytes of a batch that Python works on at once.
BATCH_BYTES = 4_000_000

_own_folder: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The shared folder for written tables: what ``spark.checkpoint.dir`` names.

    Where it is unset, a local session gets a temporary folder of its own; on a cluster that would
    be a folder which other machines can't see, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="lattica-"))
        named = f"file://{_own_folder[0]}"
    return f"{named.rstrip('/')}/lattica/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors.

    ``rows``, about how many there are of a narrow table, keeps a small one from becoming a file for each shuffle
    partition: it is written by a task for each ROWS_A_FILE rows, or by all partitions if that is more.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_A_FILE)
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lattica_path = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes the table behind a frame that materialize() returned; nothing may read it any more."""
    path = getattr(df, "_lattica_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers if they'd not find it: they look in PYTHONPATH and their own folder."""
    root = Path(__file__).resolve().parents[2]
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if str(root) not in seen and getattr(context, "_lattica_shipped", None) is None:
        packed = shutil.make_archive(f"{tempfile.mkdtemp(prefix='lattica-')}/lattica", "zip", root, "lattica")
        context.addPyFile(packed)
        context._lattica_shipped = packed


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once: lambdas that use an outer expression would compute it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unused(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores after it until no column of ``taken`` has it, in whatever case."""
    known = {x.lower() for x in taken}
    while name.lower() in known:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tidy() -> None:
    """Gives a Python worker's free memory back to the system: workers outlive their tasks and would hold it through stages without Python."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], at_once: int = BATCH_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over batches of about ``at_once`` bytes or a row, with the worker tidied at its end."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, int(batch.num_rows * at_once / max(at_once, batch.nbytes)))
            for k in range(0, batch.num_rows, rows):
                yield batch.slice(k, rows)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(slices(batches))
        finally:
            tidy()

    return whole

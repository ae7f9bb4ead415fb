"""Shared ground of the training-data operators: the cluster's shared folder,
written tables that cut lineage, and Arrow batches of bounded size."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions sent to executors carry their code with them: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules["dayloom.llm"])

#: Rows of one Arrow batch that hold texts. Texts of 100 KB then make a batch of 25 MB.
TEXT_ROWS = 256
#: And of those that Spark sends to Python workers.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


_LOCAL: dict[str, str] = {}  # folders of sessions on one machine, by application


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster names one;
    else, on one machine only, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="dayloom-")
            atexit.register(remove_dir, spark, _LOCAL[app])
        found = _LOCAL[app]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file systems; quiet if the session is over."""
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  at exit the gateway may be gone
        pass


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are over; it does so when the driver
    collects its garbage, which else may come late."""
    gc.collect()
    spark._jvm.System.gc()


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives its memory back. Spark keeps a Python worker for later tasks, and
    what a task has freed would stay with the worker while other tasks run in the executor."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def trim() -> None:
    """Gives what the process has freed back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


#: Bits of a filter that is sent to executors (4 MB), and of the blocks it is put together from.
FILTER_BITS, BLOCK_BITS = 1 << 25, 1 << 15


def bit_filter(values: DataFrame) -> Broadcast:
    """A bitmap of the low bits of a column of longs, of fixed size. It passes every value of the
    column and, the fuller it is, ever more others: what it lets through still has to be joined."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for b in batches:
            bits[np.asarray(b.column(0).drop_null(), np.int64) & (FILTER_BITS - 1)] = True
        blocks = np.packbits(bits, bitorder="little").reshape(-1, BLOCK_BITS // 8)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[i].tobytes() for i in used], pa.binary())], names=["block", "bits"])

    parts = values.select(F.col(values.columns[0]).cast("long")).mapInArrow(lean(run), "block int, bits binary").groupBy("block").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in parts.collect():  # at most FILTER_BITS / BLOCK_BITS rows
        bitmap[row.block * BLOCK_BITS // 8 : (row.block + 1) * BLOCK_BITS // 8] = np.frombuffer(row.bits, np.uint8)
    return values.sparkSession.sparkContext.broadcast(bitmap)


def passes(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & (FILTER_BITS - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class Scratch:
    """Tables written to the shared folder. ``put`` cuts lineage, so a lost executor
    costs a reread; ``drop`` frees what no later plan reads; the rest goes at exit."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, tag: str) -> DataFrame:
        path = fresh_path(self.spark, tag)
        before = self.spark.conf.get(BATCH_CONF)
        if int(before) > BATCH_ROWS:  # 10,000 rows of texts or lists fill a worker's memory
            self.spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(BATCH_CONF, before)
        atexit.register(remove_dir, self.spark, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            kept = self.paths.pop(id(t), None)
            if kept:
                remove_dir(self.spark, kept[1])
        release(self.spark)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as it takes not to clash with a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices what Spark sends, so that Python works on a bounded number of texts at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def text_or_empty(column: str) -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))

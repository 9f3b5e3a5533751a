"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WHITESPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table by Spark's own reader (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder that the session names.

    A folder of our own is made only where ``spark.checkpoint.dir`` is unset
    and Spark runs on one machine, as in tests; a cluster has to name one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a piece holds about ``most`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        if not batch.num_rows:
            continue
        if values.nbytes <= most:
            yield batch
            continue
        lengths = pc.binary_length(values).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def give_back() -> None:
    """Free memory goes back to the system, as far as its allocators can give it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other libraries than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable, end: Callable | None = None) -> Callable:
    """``run`` over the batches of a task, then ``end``; last, free memory goes back.

    Workers stay beside the steps that follow, and their allocators would hold
    the memory of their largest task.
    """

    def of(batches):
        yield from run(batches)
        if end:
            end()
        give_back()

    return of


def map_text(df: DataFrame, function: Callable, schema: str, *columns: str, most: int = 4 << 20) -> DataFrame:
    """Run ``function(list per column ...) -> dict of lists`` over bounded pieces of ``columns``; the last one is the text."""

    def run(batches):
        for piece in pieces(batches, columns[-1], most):
            yield pa.RecordBatch.from_pydict(function(*(piece.column(i).to_pylist() for i in range(len(columns)))), schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.select(*columns).mapInArrow(giving_back(run), schema)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, counted: the planner's estimate can be off by any factor."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of steps whose results are checkpointed."""
    for _ in range(3):  # what one round sets free holds what the next one does
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def keep_rows(docs: DataFrame, test: Callable[[list], list[bool]], most: int = 4 << 20, end: Callable | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose texts pass ``test``; one map stage.  ``end`` is called after a task's last row."""

    def run(batches):
        for piece in pieces(batches, "text", most):
            texts = piece.column(piece.schema.get_field_index("text")).to_pylist()
            yield piece.filter(pa.array(test(texts), pa.bool_()))

    return docs.mapInArrow(giving_back(run, end), docs.schema)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of sorted batches, one table for each run of equal values in the first ``keys`` columns (numbers, no nulls)."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        new[0] = bool(held) and tuple(c[0] for c in columns) != last
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        at = 0
        for cut in [*np.flatnonzero(new).tolist(), batch.num_rows]:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if cut < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
            at = cut
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def dealt_by(df: DataFrame, size: int, *keys: str, each: int = 1 << 26) -> DataFrame:
    """``df`` dealt by ``keys`` to a partition for every ``each`` bytes of ``size``, or to the session's number of partitions if that is more."""
    n = size // each
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)

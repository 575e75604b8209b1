"""What the corpus operators share: the shared folder, written tables, Arrow row mapping."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def name(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the one the cluster names.

    Only where none is named and all runs in one process (as in tests) a
    temporary one is set; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="veilframe-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, from the shared folder; Spark deletes the files with the last reference."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` through a Parquet table in the shared folder: lineage ends there and columns can be pruned."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/veilframe/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []  # tables of this driver, in the order in which they were written


def written_so_far() -> int:
    return len(_WRITTEN)


def discard(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Delete the tables written after the first ``since`` ones, but for the last ``keep``.

    For a caller that knows that nothing will read them again.
    """
    gone = _WRITTEN[since : len(_WRITTEN) - keep]
    del _WRITTEN[since : len(_WRITTEN) - keep]
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


BATCH_BYTES = 4 << 20  # of an Arrow batch, which the JVM holds outside its heap
GROUP_BYTES = 16 << 20  # of the groups a worker holds at a time


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches that Python workers get, as documents may be very long.

    These are settings of the session, so they hold for its other queries as
    well. A smaller number of rows set before stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


BROADCAST_ROWS = 1_000_000  # narrow rows that every executor can hold


def narrow(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, of a few small columns, marked for broadcast if its counted rows allow it; else joins shuffle.

    ``df`` should be written or checkpointed, as it is counted first.
    """
    return F.broadcast(df) if df.count() <= most else df


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``; for files, their size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


_KEPT: dict[str, dict] = {}


def keeps(module: str, store: dict) -> None:
    """``module`` keeps memory in this Python process, in ``store``."""
    _KEPT[module] = store


def forget(*but: str) -> None:
    """Let go what other modules keep in this Python process; workers are reused from stage to stage."""
    others = [store for module, store in _KEPT.items() if store and module not in but]
    for store in others:
        store.clear()
    if others:
        gc.collect()  # what they held may refer to itself
    _trim()


def _trim() -> None:
    """Give freed memory back to the system where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def append_columns(
    df: DataFrame,
    fields: Sequence[T.StructField],
    worker: Callable[[], Callable[[pa.RecordBatch], Sequence[pa.Array]]],
    drop: Sequence[str] = (),
) -> DataFrame:
    """``df`` with columns made by Python from Arrow batches; a column of the same name is replaced.

    ``worker`` is called once in each task and returns what maps a batch to the
    new arrays. The other columns pass through as Arrow buffers.
    """
    new = {f.name for f in fields}
    gone = new | set(drop)
    kept = [f for f in df.schema.fields if f.name not in gone]
    schema = T.StructType(kept + [T.StructField(f.name, f.dataType, True) for f in fields])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(worker.__module__)
        made = worker()
        for batch in batches:
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
            arrays += list(made(batch))
            yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, arrow, strict=True)], names=arrow.names)
        del made
        _trim()

    return df.mapInArrow(run, schema)


def map_groups(
    df: DataFrame,
    keys: Sequence[str],
    work: Callable[[pa.Table, list[tuple[int, int]]], Iterator[pa.RecordBatch]],
    schema: T.StructType,
    rows: int = 20_000,
) -> DataFrame:
    """Python over whole groups, many small ones at a time.

    Rows are dealt by ``keys`` and sorted by them; ``work`` gets tables of at
    least ``rows`` rows or ``GROUP_BYTES`` (or all that is left) that hold whole
    groups, with the (start, end) of each. Groups themselves must be small: the caller divides
    large ones beforehand.
    """
    import numpy as np

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for key in keys:
            column = table.column(key).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(work.__module__)
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < rows and sum(b.nbytes for b in held) < GROUP_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            at = starts(table)
            if len(at) > 1:
                cut = int(at[-1])
                yield from work(table.slice(0, cut), list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)))
                table = table.slice(cut).combine_chunks()
            held, size = table.to_batches(), table.num_rows
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            at = [*starts(table).tolist(), table.num_rows]
            yield from work(table, list(zip(at, at[1:], strict=False)))
        held, table = [], None
        _trim()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)

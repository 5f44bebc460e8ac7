"""What the text operators share: the shared work folder, written tables and reserved column names."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a master on this machine alone gets a temporary folder; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="ledgermatch-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32_000_000) -> None:
    """Let Arrow batches hold at most ``rows`` rows and about ``size`` bytes: whole texts are long, and a worker has several batches at a time."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = re.fullmatch(r"(-?\d+)([bB]?)", spark.conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def unused(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that is none of ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose values of ``column`` (text or binary) have ``most`` bytes together, or of one longer row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it: lineage ends here and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no plan still to be run reads."""
    for table in tables:
        _delete(table.sparkSession, table._written_to)


def _delete(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if place in _MADE:
        _MADE.remove(place)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Within it operators may leave tables in the shared folder; at its end they go, but for those put in the list it gives."""
    before, keep = set(_MADE), []
    yield keep
    for place in set(_MADE) - before - {t._written_to for t in keep}:
        _delete(spark, place)


def give_back() -> None:
    """Return freed memory to the system at a task's end: Python workers are reused, and later stages need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 5: the fixed split into training and held-out rows; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

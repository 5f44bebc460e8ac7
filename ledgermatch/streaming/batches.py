"""Tables that micro-batches write: each batch has a folder of its own, so a batch that is done again leaves what it left before."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import exists


def write_batch(df: DataFrame, path: str, batch_id: int | str, partition_by: list[str] | None = None) -> None:
    """Write a micro-batch's rows. A folder that is complete stays: the same batch id stands for the same input, so readers that have seen it need not see it again."""
    place = f"{path}/batch={batch_id}"
    if not exists(df.sparkSession, f"{place}/_SUCCESS"):
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by or []).parquet(place)


def is_written(spark: SparkSession, path: str, batch_id: int | str) -> bool:
    return exists(spark, f"{path}/batch={batch_id}/_SUCCESS")


def drop_batch(spark: SparkSession, path: str, batch_id: int | str) -> None:
    """Delete a micro-batch's folder, after what was made of it has been written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch_id}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches' rows with the column batch; none, if nothing has been written."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, batch string")
    return spark.read.schema(f"{schema}, batch string").option("basePath", path).parquet(f"{path}/batch=*")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, output_mode: str = "append", partitions: int | None = None) -> StreamingQuery:
    """Give every micro-batch of what is available now, with its id, to ``each``. A new stream's state is in ``partitions``; a checkpoint keeps its own number."""
    # A stream works in a copy of the session, which has the settings of its start.
    own = {_FREED: "true"} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    with _settings(stream.sparkSession, own):
        return stream.writeStream.foreachBatch(each).outputMode(output_mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _settings(spark: SparkSession, own: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def freed_shuffles(spark: SparkSession):
    """Within it, the shuffle files of a query go when it ends, not when the driver's memory is next collected."""
    return _settings(spark, {_FREED: "true"})


def ddl(df: DataFrame, *without: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in without)

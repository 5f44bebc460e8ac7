"""Writers of run tables: machine tables are replaced by run, human tables only grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.keys import name_uuid

#: Rewritten as a whole when a run is repeated.
MACHINE_TABLES = ["records", "rejects", "classified", "discrepancies", "report"]


def replace_run(df: DataFrame, path: str, run_id: str) -> None:
    """Write the run's rows in place of those that an earlier attempt left; an empty result clears them, too.

    The partition of a run is a folder, and overwriting it is one job's commit, so a repeated or lost task changes nothing.
    """
    df.where(F.col("run_id") == run_id).drop("run_id").write.mode("overwrite").parquet(_of_run(path, run_id))


def _of_run(path: str, run_id: str) -> str:
    return f"{path}/run_id={run_id.replace(':', '%3A')}"


def read_run(spark: SparkSession, path: str, run_id: str, schema: StructType) -> DataFrame:
    """A run's rows of a table."""
    own = StructType([f for f in schema if f.name != "run_id"])
    return spark.read.schema(own).parquet(_of_run(path, run_id)).withColumn("run_id", F.lit(run_id)).select(*schema.names)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def clear_run(spark: SparkSession, root: str, run_id: str, schemas: dict[str, str]) -> None:
    """Remove the run's machine results; dispositions, suggestions, actions and alerts stay."""
    for table in MACHINE_TABLES:
        if table in schemas:
            empty = spark.createDataFrame([], schemas[table])
            replace_run(empty, f"{root}/{table}", run_id)


def with_discrepancy_ids(discrepancies: DataFrame) -> DataFrame:
    """Discrepancies with an id that run and fingerprint alone determine. A run has one group for each fingerprint, so none repeats; ``assert_unique`` holds that."""
    return discrepancies.withColumn("discrepancy_id", name_uuid(F.concat_ws("|", "run_id", "fingerprint")))


def assert_unique(df: DataFrame, key: list[str], what: str) -> DataFrame:
    """``df``, after failing where rows share ``key``. Give it a written table: it is read for the test."""
    twice = df.groupBy(*key).count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"{what}: {', '.join(str(twice[k]) for k in key)}")
    return df


def absent_only(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """The new rows whose key is neither in ``existing`` nor in an earlier new row."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def append_absent(new: DataFrame, spark: SparkSession, path: str, key: str) -> int:
    """Append the rows with new keys to a table and say how many there were; a second call with the same rows adds none."""
    existing = spark.read.parquet(path) if exists(spark, path) else new.limit(0)
    added = Observation()
    absent_only(new, existing, key).observe(added, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return added.get["n"]

"""Ledgers stored by fingerprint, so that joins of a run's discrepancies with dispositions and of two runs move no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64


def store_bucketed(df: DataFrame, table: str, *, key: str = "fingerprint", buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """Write a catalog table dealt to ``buckets`` files by ``key``, sorted within them, and give it; ``path`` places it outside of the warehouse.

    Rows are dealt before writing, so a bucket is one file. Tables of as many buckets of a key meet without an exchange; each has its own number, which
    stays for its life, so choose it for the size that it will have: a task reads a bucket of each side. Fingerprints are unique in a run, so buckets are even.
    """
    dealt = df.repartition(buckets, key)
    writer = dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"drop table if exists {table}")

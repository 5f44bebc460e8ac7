"""An inverted index of three-character grams over a run's discrepancies, for searches that read few files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.sinks import exists
from .views import SEARCHED, holds_text

GRAM = 3
#: Rows of a block at most: places in it are two bytes.
BLOCK = 50_000


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("discrepancy_id"), F.lit(parts)).cast("int")


def _placed(rows: DataFrame) -> DataFrame:
    """The rows with a block, which no other task has, and their place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                places = [pa.array(np.full(some.num_rows, block)), pa.array(np.arange(some.num_rows, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays([*some.columns, *places], names=[*some.schema.names, "block", "at"])
                block += 1

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, block long, at int")


def _postings(rows: DataFrame) -> DataFrame:
    """(gram, part, block, places): where in a block rows hold a gram, as steps of two bytes from place to place.

    A row of the result stands for all of a batch's rows with a gram in a block, so few and short rows leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part, block, at = (batch.column(c).to_numpy().astype(np.int64) for c in ("part", "block", "at"))
            order = np.lexsort((at, block, part))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            part, block, at = part[order], block[order], at[order]
            found, owners = [], []
            for c in SEARCHED:
                values = [v or "" for v in batch.column(c).to_pylist()]
                signs = np.frombuffer("".join(values).encode("utf-32-le"), "<u4").astype(np.int64)
                owner = np.repeat(rank, [len(v) for v in values])
                inside = owner[GRAM - 1 :] == owner[: 1 - GRAM]
                found.append(((signs[:-2] << 42) | (signs[1:-1] << 21) | signs[2:])[inside])
                owners.append(owner[: 1 - GRAM][inside])
            grams, number = np.unique(np.concatenate(found), return_inverse=True)
            pairs = np.unique(number * len(rank) + np.concatenate(owners))
            if not len(pairs):
                continue
            number, row = np.divmod(pairs, len(rank))
            new = np.concatenate([[True], (number[1:] != number[:-1]) | (part[row[1:]] != part[row[:-1]]) | (block[row[1:]] != block[row[:-1]])])
            starts = np.flatnonzero(new)
            steps = at[row]
            steps[1:] -= np.where(new[1:], 0, at[row[:-1]])
            raw, ends = steps.astype("<u2").tobytes(), np.append(starts[1:], len(row))
            signs = np.stack([grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([signs[GRAM * i : GRAM * (i + 1)] for i in number[starts].tolist()], pa.string()), pa.array(part[row[starts]].astype(np.int32)), pa.array(block[row[starts]]),
                    pa.array([raw[2 * lo : 2 * hi] for lo, hi in zip(starts.tolist(), ends.tolist())], pa.binary()),
                ],
                names=["gram", "part", "block", "places"],
            )

    return rows.select("part", "block", "at", *[F.lower(c).alias(c) for c in SEARCHED]).mapInArrow(run, "gram string, part int, block long, places binary")


def _holders(postings: DataFrame) -> DataFrame:
    """(part, block, at): the rows that postings stand for, once for each gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, places in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.cumsum(np.frombuffer(places, "<u2"), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), pa.array(np.full(len(at), block)), pa.array(at)], names=["part", "block", "at"])

    return postings.select("part", "block", "places").mapInArrow(run, "part int, block long, at int")


def write_index(discrepancies: DataFrame, path: str, *, parts: int = 64) -> None:
    """Write the discrepancies by part of their ids, and where their grams are, sorted, so that a gram's rows lie in few row groups.

    The discrepancies are computed once, and get places in blocks as they are written. Grams are those of each searched column in lower case, by characters; they never cross
    columns. What is stored and sorted of a gram is two bytes for a row that holds it, by block. A gram that is in very many rows is dealt over files by block.
    """
    rows = discrepancies.withColumn("part", _part(parts)).repartition("part")
    _placed(rows).write.partitionBy("part").parquet(f"{path}/rows")
    spark = discrepancies.sparkSession
    stored = spark.read.schema(_placed(rows).schema).parquet(f"{path}/rows")
    _postings(stored).repartitionByRange(parts, "gram", "block").sortWithinPartitions("gram", "part").write.parquet(f"{path}/grams")


def grams_of(text: str) -> list[str]:
    """The grams that every value holding ``text`` has: those between its wildcards."""
    pieces = re.split(r"[%_]", text.lower())
    return sorted({p[i : i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)})


def search(spark: SparkSession, path: str, text: str) -> DataFrame:
    """The discrepancies that hold ``text``, as ``holds_text`` says.

    Rows that have all its grams are candidates, and only the parts of rows that hold candidates are read to verify them. A text without a
    gram (under three characters between wildcards) reads all rows.
    """
    rows = spark.read.parquet(f"{path}/rows") if exists(spark, f"{path}/rows") else None
    if rows is None:
        raise ValueError(f"no index at {path}")
    grams = grams_of(text)
    # A backslash takes the next sign out of its role in LIKE, so grams can't be told.
    if not grams or "\\" in text:
        return rows.where(holds_text(text)).drop("part", "block", "at")
    postings = spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(grams))
    having = _holders(postings).groupBy("part", "block", "at").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    parts = [r["part"] for r in having.select("part").distinct().collect()]  # at most as many as there are parts
    found = rows.where(F.col("part").isin(parts)) if parts else rows.limit(0)
    return found.join(having.select("part", "block", "at"), ["part", "block", "at"], "left_semi").where(holds_text(text)).drop("part", "block", "at")

"""Runs whose tables appear together: an attempt writes its tables aside, and one manifest file makes them the run's.

Below a root, ``attempts/run_id=R/A`` holds the tables of attempt A and ``manifests/run_id=R`` a file for each publication, numbered from 1. The highest
number is what readers see. A manifest is written under another name and renamed, which fails where the number is taken,
so of two attempts that publish at once one fails and no reader ever sees tables of both.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from .sinks import exists

_FILE = re.compile(r"(\d{8})\.json")


class PublishConflict(Exception):
    """Another attempt of the run has been published meanwhile."""


def _of_run(root: str, kind: str, run_id: str) -> str:
    return f"{root}/{kind}/run_id={run_id.replace(':', '%3A')}"


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, place = _fs(spark, folder)
    if not fs.exists(place):
        return []
    return sorted(int(m[1]) for s in fs.listStatus(place) if (m := _FILE.fullmatch(s.getPath().getName())))


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


@dataclass(frozen=True)
class Published:
    """A run as published: where its tables are, with their schemas, under the publication's number."""

    spark: SparkSession
    run_id: str
    number: int
    tables: dict[str, dict]
    facts: dict

    def table(self, name: str) -> DataFrame:
        t = self.tables[name]
        schema = StructType.fromJson(t["schema"])
        own = StructType([f for f in schema if f.name != "run_id"])
        return self.spark.read.schema(own).parquet(t["path"]).withColumn("run_id", F.lit(self.run_id)).select(*schema.names)


def published(spark: SparkSession, root: str, run_id: str) -> Published | None:
    """The run's newest publication, or None."""
    folder = _of_run(root, "manifests", run_id)
    numbers = _numbers(spark, folder)
    if not numbers:
        return None
    found = _read(spark, f"{folder}/{numbers[-1]:08d}.json")
    return Published(spark, run_id, numbers[-1], found["tables"], found["facts"])


class Attempt:
    """One attempt at a run. What it writes is nobody's until ``publish``; if it dies before, the former publication stays as it is."""

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark, self.root, self.run_id = spark, root, run_id
        before = _numbers(spark, _of_run(root, "manifests", run_id))
        self.number = (before[-1] if before else 0) + 1
        self.place = f"{_of_run(root, 'attempts', run_id)}/{uuid.uuid4().hex}"
        self.tables: dict[str, dict] = {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table of the run and give it as read back."""
        path = f"{self.place}/{name}"
        df.drop("run_id").write.parquet(path)
        self.tables[name] = {"path": path, "schema": df.schema.jsonValue()}
        return Published(self.spark, self.run_id, self.number, self.tables, {}).table(name)

    def publish(self, **facts) -> Published:
        """Make all tables written the run's, in one step, with some facts about it."""
        folder = _of_run(self.root, "manifests", self.run_id)
        fs, place = _fs(self.spark, folder)
        fs.mkdirs(place)
        _, aside = _fs(self.spark, f"{folder}/.{uuid.uuid4().hex}")
        _, final = _fs(self.spark, f"{folder}/{self.number:08d}.json")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({"run_id": self.run_id, "tables": self.tables, "facts": facts}, ensure_ascii=False).encode()))
        out.close()
        never = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            never.rename(aside, final, none)  # refuses to replace a file
        except Py4JJavaError as e:
            fs.delete(aside, False)
            raise PublishConflict(f"publication {self.number} of {self.run_id} is there already") from e
        return Published(self.spark, self.run_id, self.number, self.tables, facts)


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, number, tables, facts) of the newest publication of each run; tables and facts as JSON."""
    schema = "run_id string, number long, tables string, facts string"
    if not exists(spark, f"{root}/manifests"):
        return spark.createDataFrame([], schema)
    # The run is named in the file; it is a column that hides the folder's.
    files = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(f"{root}/manifests", wholetext=True)
    number = F.regexp_extract(F.col("_metadata.file_name"), _FILE.pattern, 1).cast("long")
    rows = files.select(F.get_json_object("value", "$.run_id").alias("run_id"), number.alias("number"), F.get_json_object("value", "$.tables").alias("tables"), F.get_json_object("value", "$.facts").alias("facts"))
    newest = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("number")))
    return rows.withColumn("__n", newest).where("__n = 1").drop("__n")


def table_of_runs(spark: SparkSession, root: str, name: str, run_ids: list[str]) -> DataFrame:
    """A table of several runs, each as last published; runs without a publication have no rows."""
    found = [p for r in run_ids if (p := published(spark, root, r)) and name in p.tables]
    if not found:
        raise ValueError(f"none of these runs has published {name}")
    out = found[0].table(name)
    for p in found[1:]:
        out = out.unionByName(p.table(name))
    return out


def vacuum(spark: SparkSession, root: str, run_id: str) -> list[str]:
    """Delete the run's attempts that its newest publication doesn't name, and the older manifests. Call it when no attempt of the run is under way."""
    now = published(spark, root, run_id)
    kept = {t["path"].rsplit("/", 2)[1] for t in now.tables.values()} if now else set()
    fs, place = _fs(spark, _of_run(root, "attempts", run_id))
    gone = []
    for s in fs.listStatus(place) if fs.exists(place) else []:
        if s.getPath().getName() not in kept:
            gone.append(s.getPath().getName())
            fs.delete(s.getPath(), True)
    folder = _of_run(root, "manifests", run_id)
    for n in _numbers(spark, folder)[:-1]:
        fs.delete(_fs(spark, f"{folder}/{n:08d}.json")[1], False)
    return gone

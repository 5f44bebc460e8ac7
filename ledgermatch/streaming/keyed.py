"""Reconciliation of a stream key by key: a group comes out as soon as its sides balance, and at the latest when its timer runs out.

The state of a group is what the batch run's aggregations keep of it, so the last row of each group equals the batch run's. State is by slot
(``slots``), in the engine's RocksDB store; a large stream begins with more slots and partitions (``sized``). It needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider (``use_rocksdb``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.match import GROUP, with_presence
from .slots import SLOTS, combined, sized, stepped, timers_step  # noqa: F401

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def keyed_groups(records: DataFrame, *, watermark: str = "1 hour", patience_seconds: int = 86_400, slots: int = SLOTS) -> DataFrame:
    """The groups of a stream of records with event time ``biz_time``, as rows of ``match_groups`` with since, revision and cause (balanced or timer).

    ``since`` is the time of the group's first record: after its timer a key begins a new group. Of equal key and ``since`` the highest revision
    holds (``latest_groups``). A group's timer stands ``patience_seconds`` of event time behind its newest record. A group that changes after it was
    emitted is emitted again when it balances anew, or at its timer, which ends it. A checkpoint goes with its number of ``slots``. Records without a time must be taken out before (``land``); those later than the watermark never reach the state.
    """
    rows = combined(records).withWatermark("biz_time", watermark)
    out = stepped(rows, timers_step(patience_seconds * 1000), slots)
    times = {f"{p}_posted": F.timestamp_micros(f"{p}_posted") for p in ("left", "right")}
    return out.withColumns({**times, "since": F.timestamp_micros("since")})


def latest_groups(emitted: DataFrame) -> DataFrame:
    """Each group once, as last emitted, with ``mixed`` and ``presence``."""
    newest = F.row_number().over(Window.partitionBy(*GROUP, "since").orderBy(F.desc("revision")))
    return with_presence(emitted.withColumn("__n", newest).where("__n = 1").drop("__n"))

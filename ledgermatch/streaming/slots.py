"""Groups of a stream kept in slots: a slot holds many groups as one value of the engine's state, which a batch reads and writes once.

A slot is a hash of a group's columns. Its value is an Arrow table of parts: records that agree in group, side and in what makes copies.
Parts are merged by Arrow's aggregations, so neither rows nor groups cost calls of the state store, and a slot that none of a batch's rows falls
into is not touched before its earliest group ends. Once a side has copies, its parts of a currency become one.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..operators.match import COPY, GROUP, with_null_refs

#: A stream keeps this number for life, as its state is found by slot. Groups of a slot are held in memory together.
SLOTS = 1024
#: Slots and partitions of a larger stream are so many that these hold about so many records each: the engine hands a partition's ended slots to Python together.
SLOT_RECORDS, PARTITION_RECORDS = 10_000, 1_000_000
_NEVER = 2**63 - 1  # stands for no time, as the least of times is kept
_LIMIT = float(2**62)

_MEASURES = [("n", "sum"), ("amount", "sum"), ("group_key", "min"), ("ref", "min"), ("status", "min"), ("posted", "min"), ("base", "sum"), ("n_base", "sum"), ("last", "max"), ("first", "min")]
_DDL = {**{c: "string" for c in GROUP}, "side": "string", "currency": "string", "entry_type": "string", "signed_amount_minor": "long", "n": "long", "amount": "long", "group_key": "string", "ref": "string", "status": "string", "posted": "long", "base": "long", "n_base": "long", "last": "long", "first": "long"}
_PARTS = pa.schema([(c, pa.string() if t == "string" else pa.int64()) for c, t in (_DDL | {"revision": "long", "changed": "long"}).items()])
_KEY = GROUP

_SIDE_TYPES = {"count": "long", "sum": "long", "currency": "string", "last_currency": "string", "ref": "string", "status": "string", "posted": "long", "base": "long", "copies": "boolean"}
#: What comes out of a group: its columns and sides, since when, the how manieth time and why.
OUTPUT = ", ".join([
    *[f"{c} string" for c in GROUP], "group_key string", *[f"{p}_{n} {t}" for p in ("left", "right") for n, t in _SIDE_TYPES.items()], "since long, revision int, cause string",
])


def combined(records: DataFrame) -> DataFrame:
    """Copies within an Arrow batch as one row, so that a key of very many records sends few to its one task. Times are microseconds."""
    rows = with_null_refs(records).select(
        *GROUP, *COPY, "group_key", F.col("raw_ref").alias("ref"), F.col("biz_status").alias("status"), F.coalesce(F.unix_micros("posting_time"), F.lit(_NEVER)).alias("posted"),
        F.coalesce("base_amount_minor", F.lit(0)).cast("long").alias("base"), F.col("base_amount_minor").isNotNull().cast("long").alias("n_base"), "biz_time", F.unix_micros("biz_time").alias("last"),
    )
    # pandas takes the years 1678 to 2262; the column serves the watermark alone, and times are kept in ``first`` and ``last``.
    near = F.greatest(F.least("biz_time", F.lit("2262-01-01").cast("timestamp")), F.lit("1678-01-01").cast("timestamp"))
    rows = rows.withColumns({"n": F.lit(1).cast("long"), "amount": F.col("signed_amount_minor"), "first": F.col("last"), "biz_time": near})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = _aggregated(pa.Table.from_batches([batch]), [*GROUP, *COPY], [*_MEASURES, ("biz_time", "max")])
                yield from out.select([*_DDL, "biz_time"]).combine_chunks().to_batches()

    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in _DDL.items()) + ", biz_time timestamp")


def _aggregated(table: pa.Table, keys: list[str], measures: list[tuple[str, str]]) -> pa.Table:
    """Named as before. Sums are exact: those that may pass 64 bits are taken in decimals, and fail if they do."""
    for c in {c for c, how in measures if how == "sum"}:
        if np.abs(table[c].to_numpy().astype(float)).sum() > _LIMIT:
            table = table.set_column(table.column_names.index(c), c, table[c].cast(pa.decimal128(38)))
    out = table.group_by(keys, use_threads=False).aggregate(measures).select([*keys, *[f"{c}_{how}" for c, how in measures]]).rename_columns([*keys, *[c for c, _ in measures]])
    for c, how in measures:
        if how == "sum" and out[c].type != pa.int64():
            out = out.set_column(out.column_names.index(c), c, out[c].cast(pa.int64()))
    return out


def _codes(table: pa.Table, names: list[str]) -> np.ndarray:
    """A number for each row, equal where all of ``names`` are, from 0 without gaps."""
    out = np.zeros(len(table), np.int64)
    for c in names:
        column = table[c].combine_chunks()
        coded = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode("encode")
        out = out * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False)
        out = np.unique(out, return_inverse=True)[1]
    return out


def _put(table: pa.Table, **columns) -> pa.Table:
    for c, values in columns.items():
        at = table.column_names.index(c)
        table = table.set_column(at, c, pa.array(values, table.schema.field(c).type) if isinstance(values, np.ndarray) else values)
    return table


def _merged(parts: pa.Table) -> pa.Table:
    measures = [*_MEASURES, ("revision", "max"), ("changed", "max")]
    parts = _aggregated(parts, [*_KEY, *COPY], measures)
    side = _codes(parts, [*_KEY, "side"])
    copied = (parts["n"].to_numpy() > 1) | parts["signed_amount_minor"].is_null().to_numpy()
    whole = np.bincount(side, weights=copied) > 0
    if whole.any():
        hidden = pa.array(whole[side])
        bare = {c: pc.if_else(hidden, pa.scalar(None, parts.schema.field(c).type), parts[c]) for c in ("entry_type", "signed_amount_minor")}
        parts = _aggregated(_put(parts, **bare), [*_KEY, *COPY], measures)
    return parts.select(_PARTS.names)


def _groups(parts: pa.Table) -> pa.Table:
    """One row for each group of merged parts, as in OUTPUT without the cause."""
    table, wanted = parts.select([*_KEY, "group_key", "first", "last", "revision", "changed"]), [("group_key", "min"), ("first", "min"), ("last", "max"), ("revision", "max"), ("changed", "max")]
    for side, p in (("LEFT", "left"), ("RIGHT", "right")):
        here = pc.equal(parts["side"], side)
        of = lambda column, other=None, here=here: pc.if_else(here, column, pa.scalar(other, column.type))
        for name, column, how in (("count", of(parts["n"], 0), "sum"), ("sum", of(parts["amount"], 0), "sum"), ("n_base", of(parts["n_base"], 0), "sum"), ("base", of(parts["base"], 0), "sum"),
                                  ("currency", of(parts["currency"]), "min"), ("last_currency", of(parts["currency"]), "max"), ("ref", of(parts["ref"]), "min"), ("status", of(parts["status"]), "min"),
                                  ("posted", of(parts["posted"], _NEVER), "min"), ("copies", pc.and_(here, parts["signed_amount_minor"].is_null()), "max")):
            table, wanted = table.append_column(f"{p}_{name}", column), [*wanted, (f"{p}_{name}", how)]
    out = _aggregated(table, _KEY, wanted)
    for p in ("left", "right"):
        known = pc.and_(pc.equal(out[f"{p}_n_base"], out[f"{p}_count"]), pc.greater(out[f"{p}_count"], 0))
        none = pa.scalar(None, pa.int64())
        out = _put(out, **{f"{p}_base": pc.if_else(known, out[f"{p}_base"], none), f"{p}_posted": pc.if_else(pc.equal(out[f"{p}_posted"], _NEVER), none, out[f"{p}_posted"])})
    return out


def sized(records: int, partitions: int) -> tuple[int, int]:
    """Slots and partitions, at least SLOTS and ``partitions``, for a stream whose state may hold so many records at once."""
    slots = SLOTS
    while slots * SLOT_RECORDS < records:
        slots *= 2
    return slots, max(partitions, -(-records // PARTITION_RECORDS))


_ORDER = [c.split()[0] for c in OUTPUT.split(", ")]


def _frames(groups: pa.Table, cause: str | None, most: int = 10_000) -> Iterator[pd.DataFrame]:
    """Rows as pandas has them are many times larger than in Arrow, so they are given few at a time."""
    out = groups.append_column("since", groups["first"]).append_column("cause", pa.array([cause] * len(groups), pa.string())).select(_ORDER)
    for at in range(0, len(out), most):
        yield out.slice(at, most).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.bool_(): pd.BooleanDtype()}.get)


def _read(state) -> pa.Table:
    return pa.ipc.open_stream(state.get[0]).read_all() if state.exists else _PARTS.empty_table()


def _keep(state, parts: pa.Table, ends: np.ndarray) -> None:
    """Store a slot, to be called when the watermark (in milliseconds) reaches the first of ``ends``."""
    if not len(parts):
        if state.exists:
            state.remove()
        return
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _PARTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(parts.combine_chunks())
    state.update((out.getvalue().to_pybytes(),))
    # The engine calls when the watermark is past the time that is set, so it is the millisecond before.
    state.setTimeoutTimestamp(max(int(ends.min()) - 1, 1))


def _with_new(state, frames: Iterator[pd.DataFrame]) -> pa.Table:
    """A slot's parts with a batch's rows, which are merged whenever they are many."""
    parts, new, waiting = _read(state), [], 0
    for frame in frames:
        if len(frame):
            new.append(pa.Table.from_pandas(frame.assign(revision=0, changed=1)[_PARTS.names], _PARTS, preserve_index=False))
            waiting += len(frame)
            if waiting > max(len(parts), 100_000):
                parts, new, waiting = _merged(pa.concat_tables([parts, *new])), [], 0
    return _merged(pa.concat_tables([parts, *new])) if new else parts


def timers_step(patience: int) -> Callable:
    """Groups come out when they balance, and when the watermark reaches ``patience`` milliseconds behind their newest record, which ends them."""

    def step(key, frames, state):
        warnings.filterwarnings("ignore", "The behavior of DataFrame concatenation", FutureWarning)  # of the engine's serializer, for each slot
        parts = _with_new(state, frames)
        groups = _groups(parts)
        of = {c: groups[c].to_numpy(zero_copy_only=False) for c in ("changed", "revision", "last")}
        same = [pc.equal(groups["left_sum"], groups["right_sum"]), pc.greater(groups["left_count"], 0), pc.greater(groups["right_count"], 0)]
        same += [pc.equal(groups["left_currency"], groups[c]) for c in ("left_last_currency", "right_currency", "right_last_currency")]
        balanced = of["changed"] == 1
        for test in same:
            balanced = balanced & pc.fill_null(test, False).to_numpy()
        revision, changed = of["revision"] + balanced, np.where(balanced, 0, of["changed"])
        groups = _put(groups, revision=revision)
        ends = of["last"] // 1000 + patience
        open_ = ends > state.getCurrentWatermarkMs()
        # Parts find their groups by number: both are in one table of keys.
        numbers = _codes(pa.concat_tables([groups.select(_KEY), parts.select(_KEY)]), _KEY)
        at = np.empty(len(groups), np.int64)
        at[numbers[: len(groups)]] = np.arange(len(groups))
        at = at[numbers[len(groups) :]]
        kept = _put(parts, revision=revision[at], changed=changed[at]).filter(pa.array(open_[at]))
        _keep(state, kept, ends[open_])
        if balanced.any():
            yield from _frames(groups.filter(pa.array(balanced)), "balanced")
        late = ~open_ & (changed == 1)
        if late.any():
            yield from _frames(_put(groups, revision=revision + 1).filter(pa.array(late)), "timer")

    return step


def stepped(rows: DataFrame, step: Callable, slots: int = SLOTS) -> DataFrame:
    """Run ``step`` over combined rows with their watermark."""
    slot = F.pmod(F.xxhash64(*GROUP), F.lit(slots)).cast("int").alias("slot")
    return rows.select(slot, "*").groupBy("slot").applyInPandasWithState(step, OUTPUT, "parts binary", "append", "EventTimeTimeout")

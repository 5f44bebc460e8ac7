"""Token ids in binary files: frequency ranks in byte-aligned variable-length coding with separate control bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import byte_slices, give_back, new_path, small_batches, task_number
from .tokens import tokenizer

# File: magic, five u64 (documents, ids, distinct ids, control bytes, data bytes), then i64 document ids, u8 null marks,
# u32 lengths, u32 id of each rank, control bytes, data bytes. All little-endian.
MAGIC = b"RANKVB01"
_SHIFTS = np.array([0, 2, 4, 6], np.uint8)
#: Bytes of the four numbers that a control byte describes.
_LENGTHS = (((np.arange(256)[:, None] >> _SHIFTS) & 3) + 1).astype(np.uint8)


def encode_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes (two bits for each number, its bytes less one) and data bytes (one to four, little-endian)."""
    numbers = numbers.astype("<u4")
    n = len(numbers)
    extra = (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = extra
    control = (padded.reshape(-1, 4) << _SHIFTS).sum(axis=1, dtype=np.uint8)
    keep = np.arange(4, dtype=np.uint8) <= extra[:, None]
    return control.tobytes(), numbers.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def decode_numbers(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The inverse: a table gives four lengths for each control byte, and the lengths give the place of each number."""
    lengths = _LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    out = data[starts].astype(np.uint32)
    for byte in (1, 2, 3):
        longer = np.flatnonzero(lengths > byte)
        if not len(longer):
            break
        out[longer] |= data[starts[longer] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


def pack_file(doc_ids: list[int | None], encoded: list[bytes]) -> bytes:
    """One file's bytes. Ranks are by frequency over the file's documents, ties to the smaller id."""
    ids = np.frombuffer(b"".join(encoded), "<u4")
    kinds, places, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    control, data = encode_numbers(rank[places] if len(ids) else np.zeros(0, np.uint32))
    head = np.array([len(doc_ids), len(ids), len(kinds), len(control), len(data)], "<u8")
    return b"".join([
        MAGIC, head.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array([len(e) // 4 for e in encoded], "<u4").tobytes(), kinds[order].astype("<u4").tobytes(), control, data,
    ])


def unpack_file(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, null marks, lengths, and all ids of a file."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n, kinds, n_control, n_data = (int(x) for x in np.frombuffer(content, "<u8", 5, 8))
    at = 48
    parts = []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", kinds), ("u1", n_control), ("u1", n_data)):
        parts.append(np.frombuffer(content, kind, count, at))
        at += parts[-1].nbytes
    doc_ids, nulls, lengths, table, control, data = parts
    return doc_ids, nulls, lengths, table[decode_numbers(control, data, n)] if n else np.zeros(0, np.uint32)


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, *, end_id: int = 2, file_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents below ``path`` in ascending id order and return the manifest, one row for each file.

    Documents are dealt into ranges of ids and sorted within them, so names in ascending order hold ids in
    ascending order (null ids first; rows of one id by a hash of their text, which also divides an id of many rows). A file ends after ``file_tokens`` ids, which bounds a
    task's memory. A file gets its name only when complete, so a repeated task replaces it by the same bytes.
    Null text counts as empty: its document is the end id alone. An empty table gives no files and an empty manifest.
    """
    spark = docs.sparkSession
    small_batches(spark)
    store, root = fs.FileSystem.from_uri(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        store, root = fs.FileSystem.from_uri(path)
        doc_ids: list[int | None] = []
        encoded: list[bytes] = []
        held, task, files = 0, task_number(), 0
        made: list[tuple] = []

        def close() -> None:
            nonlocal held, files
            if doc_ids:
                name = f"tokens-{task:08d}-{files:06d}.bin"
                store.create_dir(root, recursive=True)
                unfinished = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(unfinished) as out:
                    out.write(pack_file(doc_ids, encoded))
                store.move(unfinished, f"{root}/{name}")
                made.append((name, task, files, len(doc_ids), held))
                files += 1
            doc_ids.clear()
            encoded.clear()
            held = 0

        for batch in batches:
            for part in byte_slices(batch, "text", 1_000_000):
                new = [e + end for e in tok.encode(part.column(1).to_pylist())]
                for d, e in zip(part.column(0).to_pylist(), new):
                    doc_ids.append(d)
                    encoded.append(e)
                    held += len(e) // 4
                    if held >= file_tokens:
                        close()
        close()
        give_back()
        columns = list(zip(*made)) or [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "task", "number", "n_docs", "n_tokens"])

    store.create_dir(root, recursive=True)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    ranged = keyed.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th").drop("th")
    ranged.mapInArrow(run, "file string, task long, number long, n_docs long, n_tokens long").write.parquet(f"{path}-manifest")
    return spark.read.parquet(f"{path}-manifest")


def read_token_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of the files of a manifest; ``start`` counts the ids of all documents before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before, content in zip(*(c.to_pylist() for c in batch.columns)):
                doc_ids, nulls, lengths, ids = unpack_file(content)
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                for at in range(0, len(doc_ids), 2000):
                    s = slice(at, at + 2000)
                    blobs = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends[s].tolist(), lengths[s].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[s], mask=nulls[s].astype(bool)), pa.array(ends[s] - lengths[s] + before), pa.array(lengths[s].astype(np.int64)), pa.array(blobs, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    # Ids before a file: those of earlier tasks, summed by task first, and those of the same task's earlier files.
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = manifest.groupBy("task").agg(F.sum("n_tokens").alias("n")).select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy("task").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).join(tasks, "task").select("file", (F.col("base") + F.col("own")).alias("before"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.join(starts, "file").select("file", "before", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_table(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and read them back."""
    path = new_path(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, tokenizer_path, path, **options)
    return read_token_files(docs.sparkSession, path, manifest)

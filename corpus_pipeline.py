"""The corpus pipeline: documents in, packed training windows out.

Null and empty texts have no letter and go in the first stage. The middle stages take them nevertheless: they leave such a document as it
is (line and string removal) or keep it (near duplicates), a null text stays null, and a document without an id is kept and never a
copy of another. Rows that repeat id and text count as one document, so none removes the other: all of them stay, or go. An empty
table gives an empty one. Columns other than those of ``documents`` are left out, whatever their names.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with the columns of ``documents``; the last gives
the packed pieces. ``run`` writes each stage's rows to the shared folder, reads them again for the next, and then deletes
them with all that the stage has left there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgermatch.llm import language_id, line_dedup, minhash, packing, suffix_dedup
from ledgermatch.llm.common import discard, fold, read_table, scratch, written
from ledgermatch.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter. A given lang stays; the network decides it for rows without one, unless there was nothing to learn from."""
    network = language_id.train(docs, usable=fold(F.col("doc_id")) != 0)
    lettered = docs.select(*COLUMNS).where(language_id.has_letter(F.col("text")))
    if network is None:
        return lettered
    return language_id.identify(lettered, network).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of passages of three lines."""
    return line_dedup.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the smallest id."""
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.select(*COLUMNS).join(kept, docs["doc_id"].eqNullSafe(F.col("kept_id")), "left_semi")


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that occur elsewhere; a character of which a byte went goes as a whole."""
    kept = suffix_dedup.remove_repeats(docs, carry=[c for c in COLUMNS if c != "text"], as_text=True)
    return kept.withColumnRenamed("kept", "text").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' token ids in windows of 2048, each of one language: that given, or the one that the first stage identified."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), by="lang")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_strings),
    ("packing", pack_windows),
]
#: Language identification, the suffix stage and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
            keep.append(docs)
        if last is not None:
            discard(last)
        last = docs
    return docs

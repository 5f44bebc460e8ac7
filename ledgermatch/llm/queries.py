"""The registered queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import collocations, language_id, line_dedup, minhash, packing, periodic_runs, piece_codec, quality_mil, suffix_dedup, suffix_tree_lm, token_files, topk_search, vector_dedup
from .common import fold, read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = language_id.train(docs, usable=fold(F.col("doc_id")) != 0)
    return language_id.identify(docs.select("doc_id", "text"), network).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_files.token_table(docs, tokenizer_path("word_bpe_49k.json")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, is_query=F.col("vec_id") % 50 == 0)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = piece_codec.PieceModel(tokenizer_path("piece_bpe_32k.model"))
    coded = piece_codec.encode(docs, model)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "best_pieces", "best_score", F.sha2(piece_codec.decoded_text(F.col("ids"), model), 256).alias("decoded_sha256"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    packed = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


def vector_links_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's operator over the vectors and near copies of a third of them, a ninth twice: all embeddings alone hold hardly a link. Copies differ by a twentieth of their length."""
    given = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    number = F.explode(F.sequence(F.lit(0), F.when(F.col("vec_id") % 9 == 0, 2).when(F.col("vec_id") % 3 == 0, 1).otherwise(0))).alias("copy")
    rows = given.select("vec_id", "embedding", number, F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x) / F.size("embedding")).alias("size"))
    noise = lambda x, i: x + F.col("copy") * 0.05 * F.col("size") * F.sin(F.col("vec_id") * 7.3 + F.col("copy") * 2.1 + i * 1.7)
    copies = rows.select((F.col("vec_id") + F.col("copy") * 1_000_000_000).alias("vec_id"), F.transform("embedding", noise).alias("embedding"))
    return vector_dedup.near_duplicate_vectors(copies)


def op9_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id")) == 1
    scored = suffix_tree_lm.score_texts(docs, training=fold(F.col("doc_id")) != 1)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


def op12_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = quality_mil.train(docs, labels, usable=~held_out)
    return quality_mil.judge(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def _perturbed() -> Column:
    """The contract's rewriting: in a tenth of the documents the words from one place on repeat a stretch of the text."""
    g = F.expr("__h div 10")
    n = F.size("__words")
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    again = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(F.col("__words"), a + i % p))
    return F.when(n > 0, F.array_join(F.concat(F.slice(F.col("__words"), F.lit(1), a), again), " ")).otherwise(F.col("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("__h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    docs = docs.withColumn("__words", F.when(F.col("__h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    found = periodic_runs.find_runs(docs.select("doc_id", _perturbed().alias("text")), periods=4, min_length=6)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.withColumn("__top", longest)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("__top.start")).alias("start"), F.col("__top.length").alias("length"), (-F.col("__top.period")).alias("period"),
        F.expr("1000 * __top.length div -__top.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_token_files": op2_token_files,
    "op3_topk_search": op3_topk_search,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_piece_codec": op5_piece_codec,
    "op6_minhash": op6_minhash,
    "op7_packing": op7_packing,
    "op8_vector_dedup": op8_vector_dedup,
    "op9_suffix_tree_lm": op9_suffix_tree_lm,
    "op10_line_dedup": op10_line_dedup,
    "op11_collocations": op11_collocations,
    "op12_quality_mil": op12_quality_mil,
    "op13_periodic_runs": op13_periodic_runs,
    "vector_links_planted": vector_links_planted,
}

ORACLE_SQL = {"op3_topk_search": topk_search.ORACLE_SQL, "op10_line_dedup": line_dedup.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL}

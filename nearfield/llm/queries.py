"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, lm, media, mixing, quality, rules, simhash, substring, urls


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of a document that an earlier document has, or nearly has."""
    return substring.repeated_passages(documents(spark, sf_dir).select("doc_id", "text"))


def op2_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a mu-law WAV file: digests of the file, of the payload read back and of its PCM, and its feature."""
    out = media.load(media.store(documents(spark, sf_dir).select("doc_id", "text")))
    return out.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.length("pcm16k").cast("long").alias("pcm_bytes"),
        F.sha2("pcm16k", 256).alias("pcm_sha256"),
    )


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, its base verdict, and the verdict with its host's."""
    out = rules.judge(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's number of ids and the digests of its ids and of the text they decode to."""
    out = bpe.encode_documents(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path()).drop("text")
    return out.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("token_ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op5_weighted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    out = urls.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op6_consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its host's winning path."""
    out = html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, source size, target and words taken of every document."""
    out = mixing.systematic(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.components(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and interpolated log10 probability of every document."""
    return lm.score(documents(spark, sf_dir).select("doc_id", "text"))


def op10_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a ranker learned from the labels outside the held-out fold."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.train(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    out = quality.score(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compact_windows": op1_compact_windows,
    "op2_telephony_audio": op2_telephony_audio,
    "op3_host_rules": op3_host_rules,
    "op4_forced_boundary_bpe": op4_forced_boundary_bpe,
    "op5_weighted_urls": op5_weighted_urls,
    "op6_consensus_paths": op6_consensus_paths,
    "op7_systematic_mix": op7_systematic_mix,
    "op8_simhash_bk_trees": op8_simhash_bk_trees,
    "op9_deleted_interpolation": op9_deleted_interpolation,
    "op10_bradley_terry": op10_bradley_terry,
}

ORACLE_SQL: dict[str, str] = {
    "op3_host_rules": rules.ORACLE,
    "op5_weighted_urls": urls.oracle_sql(),
    "op7_systematic_mix": mixing.ORACLE,
}

"""The registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_extract, lm_scores, merkle, near_dedup, oracles, packing, prefix_trie, quality_classifier, quality_rules, sharding, token_files, warc
from .common import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where a public vocabulary file is; the operators take any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(table(spark, sf_dir, "documents"), shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "keeper")


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0, plain_marks=False)
    return token_files.read_token_files(manifest)


def op6_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotated(table(spark, sf_dir, "conversations"))


def perspective_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The renderings of op6 in parts of a few messages: for dialogues too long for a row."""
    return chat_format.parts(table(spark, sf_dir, "conversations"), oracles.FEW)


def op7_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, heads = warc.write_archives(table(spark, sf_dir, "pages"), least=0)
    found = warc.originals(written(warc.read_archives(manifest), "read"), heads)
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("of_page").alias("refers_to"))


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.graded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_block_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    cut = packing.token_pieces(docs, tokenizer("word_bpe_49k.json"), length=4096, end_id=1, plain_marks=False)
    digested = cut.select("doc_id", "row", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digested, length=4096).drop("row")


def op11_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm_scores.scores(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_jump_hash_shards, op2_quality_rules, op3_simhash_near_dedup, op4_template_decontamination, op5_token_files, op6_perspective_rotation, op7_content_addressed_warc, op8_ordinal_quality, op9_block_tree_extraction, op10_best_fit_packing, op11_attention_scores, op12_prefix_trie, op13_merkle_manifest, perspective_parts]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)

"""The operators' queries over whole tables, with their production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import alignment, bwt_dedup, dac, decontaminate, hpylm, mixing, prefix_trie, quality, simhash, suffix_dedup, template, toxicity, warc
from corpusloom.llm.common import table


#: Id that closes each document.
END_ID = 2
#: Conversations of a family begin with turns of its first one, at most so many.
FAMILY, MOST_SHARED = 5, 8


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.tokenise(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.main_text(table(spark, sf_dir, "pages"))


def op5_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (alignment.ByteTokens, public_tokenizers.path("byte_bpe_50k.json")), (alignment.PieceTokens, public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.align(table(spark, sf_dir, "documents"), a, b)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefix_trie.spliced(prefix_trie.numbered(table(spark, sf_dir, "conversations")), FAMILY, MOST_SHARED)
    return prefix_trie.digest(prefix_trie.trie(turns, convs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_warc_archive, op2_pitman_yor, op3_token_files, op4_main_text, op5_mix_to_weights, op6_quality_rules, op7_substring_dedup, op8_simhash_near_dedup, op9_toxicity, op10_decontaminate, op11_byte_dedup, op12_token_alignment, op13_prefix_trie)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_archive": warc.ORACLE_SQL, "op5_mix_to_weights": mixing.ORACLE_SQL, "op6_quality_rules": quality.ORACLE_SQL, "op7_substring_dedup": suffix_dedup.ORACLE_SQL, "op11_byte_dedup": bwt_dedup.ORACLE_SQL, "op13_prefix_trie": prefix_trie.ORACLE_SQL}

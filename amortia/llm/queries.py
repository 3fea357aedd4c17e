"""The registered queries of this subpackage, with production parameters, and their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amortia.llm import chat, decontam, filter_audit, line_templates, quality, spelling
from amortia.llm.common import table
from amortia.session import work_path

VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        _QUERIES[name] = fn
        if oracle:
            _ORACLES[name] = oracle
        return fn
    return deco


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_quality_rules", quality.ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op5_line_templates", line_templates.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@register("op2_tool_call_linking", chat.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.calls_of(table(spark, sf_dir, "conversations"))
    return chat.link_tool_calls(calls, results, chat.SCHEMAS).select(
        "conv_id", "call_id", "turn", "name", "depth", "ordinal", "status", "valid", F.sha2("message", 256).alias("message_sha256"))


@register("op3_bloom_lm_scoring")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from amortia.llm import bloom_lm

    return bloom_lm.score_documents(table(spark, sf_dir, "documents"))


@register("op4_suffix_sort_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from amortia.llm import suffix_dedup

    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@register("op6_minhash_hamming_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from amortia.llm import near_dup

    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=2, similarity=0.8).select(
        "doc_id", "n_shingles", "component_id", "kept")


@register("op7_positional_index_decontam", decontam.ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k")


@register("op8_bpe_encode_decode")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from amortia.llm import bpe

    return bpe.token_digests(table(spark, sf_dir, "documents"), vocabulary_path())


@register("op9_centroid_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from amortia.llm import langid

    return langid.identify(table(spark, sf_dir, "documents"))


@register("op10_wavelet_token_shards")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from amortia.llm import wavelet

    path = work_path(spark, f"llm-shards-{uuid.uuid4().hex}")
    wavelet.write_shards(table(spark, sf_dir, "documents"), path, vocabulary_path())
    return wavelet.read_documents(spark, path)


@register("op11_two_tier_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from amortia.llm import token_counts

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path(PIECES))


@register("op12_filter_interaction_audit", filter_audit.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op13_permuterm_spelling", spelling.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)

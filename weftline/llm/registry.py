"""The operators' queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import op1_warc, op2_permutation, op3_bpe, op4_suffix, op5_quality, op6_substring, op7_simhash, op8_decontam, op9_langid, op10_html, op11_codes, op12_repair, op13_chat, oracles


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_chunks": op1_warc.query,
        "op2_permutation_index": op2_permutation.query,
        "op3_bpe_encode_decode": op3_bpe.query,
        "op4_suffix_dedup": op4_suffix.query,
        "op5_quality_resampling": op5_quality.query,
        "op6_substring_dedup": op6_substring.query,
        "op7_simhash_near_dedup": op7_simhash.query,
        "op8_decontamination": op8_decontam.query,
        "op9_language_id": op9_langid.query,
        "op10_html_extraction": op10_html.query,
        "op11_vector_codes": op11_codes.query,
        "op12_conversation_repair": op12_repair.query,
        "op13_chat_formatting": op13_chat.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_chunks": oracles.WARC,
        "op6_substring_dedup": oracles.SUBSTRING,
        "op8_decontamination": oracles.DECONTAMINATION,
        "op11_vector_codes": oracles.CODES,
        "op12_conversation_repair": oracles.REPAIR,
        "op13_chat_formatting": oracles.CHAT,
    }

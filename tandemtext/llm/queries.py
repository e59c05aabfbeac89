"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tandemtext.llm import bpe, chunking, hilbert, html_blocks, language, lempel_ziv, mixing, quality, secrets_crf, simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_neardup": simhash.op1_simhash_neardup,
    "op2_hilbert_ann": hilbert.op2_hilbert_ann,
    "op3_lz_fingerprint": lempel_ziv.op3_lz_fingerprint,
    "op4_html_text": html_blocks.op4_html_text,
    "op5_language_id": language.op5_language_id,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_substring_dedup": chunking.op7_substring_dedup,
    "op8_bpe_tokens": bpe.op8_bpe_tokens,
    "op9_quality_resample": quality.op9_quality_resample,
    "op10_secret_scan": secrets_crf.op10_secret_scan,
}
ORACLES: dict[str, str] = {"op2_hilbert_ann": hilbert.ORACLE, "op6_mix_sources": mixing.ORACLE}

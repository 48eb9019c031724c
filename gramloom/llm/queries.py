"""The driver's queries of this subpackage, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gramloom.llm.chat import op5_chat_formatting
from gramloom.llm.common import load
from gramloom.llm.decontaminate import op3_benchmark_decontamination
from gramloom.llm.fingerprint import op7_document_fingerprints
from gramloom.llm.langid import op9_language_id
from gramloom.llm.mixing import op6_source_mixing
from gramloom.llm.pii import op10_pii_pseudonyms
from gramloom.llm.secrets import op8_secret_scan
from gramloom.llm.simhash import op2_simhash_near_duplicates
from gramloom.llm.sql import ORACLES
from gramloom.llm.substring import op4_substring_dedup
from gramloom.llm.warc import op1_warc_derivatives


def _on(op: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(spark, *[load(spark, sf_dir, t) for t in tables])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": _on(op1_warc_derivatives, "pages"),
    "op2_simhash_near_duplicates": _on(op2_simhash_near_duplicates, "documents"),
    "op3_benchmark_decontamination": _on(op3_benchmark_decontamination, "documents", "benchmark"),
    "op4_substring_dedup": _on(op4_substring_dedup, "documents"),
    "op5_chat_formatting": _on(op5_chat_formatting, "conversations"),
    "op6_source_mixing": _on(op6_source_mixing, "documents"),
    "op7_document_fingerprints": _on(op7_document_fingerprints, "documents"),
    "op8_secret_scan": _on(op8_secret_scan, "documents"),
    "op9_language_id": _on(op9_language_id, "documents"),
    "op10_pii_pseudonyms": _on(op10_pii_pseudonyms, "documents"),
}
__all__ = ["ORACLES", "QUERIES"]

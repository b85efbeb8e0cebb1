"""One query an operator, over its whole table, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, jaccard, langid, licences, mixing, packing, pii, simhash, topk, wrappers
from .common import table


def _over(name: str, operator: Callable[[SparkSession, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(spark, table(spark, sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licence_scan": _over("documents", licences.licence_scan),
    "op2_chat_formatting": _over("conversations", chat.chat_format),
    "op3_document_fingerprints": _over("documents", simhash.document_fingerprints),
    "op4_exact_top_k": _over("embeddings", topk.top_k),
    "op5_pii_surrogates": _over("documents", pii.surrogates),
    "op6_packing": _over("documents", packing.pieces),
    "op7_ngram_jaccard": _over("documents", jaccard.ngram_jaccard),
    "op8_html_extraction": _over("pages", wrappers.page_texts),
    "op9_source_mixing": _over("documents", mixing.mixture),
    "op10_language_id": _over("documents", langid.language_id),
}

ORACLES: dict[str, str] = {
    "op2_chat_formatting": chat.ORACLE,
    "op4_exact_top_k": topk.ORACLE,
}

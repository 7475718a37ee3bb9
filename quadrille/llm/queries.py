"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_trie, exact_dedup, licenses, mixing, ngram_join, pii, quality, sentencepiece_lattice, spelling, token_records, toxicity, urls, vector_codes
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_pseudonyms": lambda s, d: pii.report(table(s, d, "documents")),
    "op2_ngram_jaccard_join": lambda s, d: ngram_join.linked(table(s, d, "documents"), ngram_join.Spec(n=4, percent=85)),
    "op3_exact_dedup": lambda s, d: exact_dedup.report(table(s, d, "documents")),
    "op4_token_records": lambda s, d: token_records.report(table(s, d, "documents")),
    "op5_quality_rules": lambda s, d: quality.report(table(s, d, "documents"), table(s, d, "labels")),
    "op6_license_scan": lambda s, d: licenses.scan(table(s, d, "documents")),
    "op7_toxicity": lambda s, d: toxicity.report(table(s, d, "documents"), table(s, d, "labels")),
    "op8_sentencepiece": lambda s, d: sentencepiece_lattice.report(table(s, d, "documents")),
    "op9_source_mix": lambda s, d: mixing.report(table(s, d, "documents")),
    "op10_url_filter": lambda s, d: urls.judge(table(s, d, "pages")),
    "op11_spelling_variants": lambda s, d: spelling.report(table(s, d, "documents")),
    "op12_vector_codes": lambda s, d: vector_codes.report(table(s, d, "embeddings")),
    "op13_bpe_trie": lambda s, d: bpe_trie.report(table(s, d, "documents")),
}
ORACLES: dict[str, str] = {"op2_ngram_jaccard_join": ngram_join.ORACLE, "op3_exact_dedup": exact_dedup.ORACLE, "op10_url_filter": urls.ORACLE, "op12_vector_codes": vector_codes.ORACLE}

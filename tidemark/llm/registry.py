"""Queries of the training-data operators and their SQL."""

from tidemark.llm import bpe, collocations, html_text, jaccard_join, lm_scoring, media, mixing, packing, prefix_trie, quality, substring_dedup, toxicity, url_filters

MODULES = (packing, quality, lm_scoring, substring_dedup, media, toxicity, bpe, html_text, url_filters, jaccard_join, prefix_trie, mixing, collocations)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}

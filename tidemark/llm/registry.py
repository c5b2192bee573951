"""Queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from . import bpe, decontaminate, html_text, jaccard, licences, neighbours, secrets, token_files, toxicity, url_filter

QUERIES = {
    "op1_secret_scan": secrets.query,
    "op2_toxicity": toxicity.query,
    "op3_url_filter": url_filter.query,
    "op4_byte_bpe": bpe.query,
    "op5_licence_scan": licences.query,
    "op6_embedding_neighbours": neighbours.query,
    "op7_token_files": token_files.query,
    "op8_html_text": html_text.query,
    "op9_decontamination": decontaminate.query,
    "op10_ngram_jaccard": jaccard.query,
}

ORACLE: dict[str, str] = {}

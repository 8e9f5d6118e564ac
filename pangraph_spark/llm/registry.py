"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe_codec, fingerprints, licenses, packing, secrets, similarity, substrings, token_counts, topk, toxicity

QUERIES = {
    "op1_secret_scan": secrets.query,
    "op2_license_scan": licenses.query,
    "op3_ngram_jaccard_join": similarity.query,
    "op4_token_counts": token_counts.query,
    "op5_exact_topk": topk.query,
    "op6_bpe_codec": bpe_codec.query,
    "op7_toxicity": toxicity.query,
    "op8_best_fit_packing": packing.query,
    "op9_document_fingerprints": fingerprints.query,
    "op10_substring_dedup": substrings.query,
}
SQL: dict[str, str] = {
    "op2_license_scan": licenses.sql(),
    "op3_ngram_jaccard_join": similarity.SQL,
    "op5_exact_topk": topk.SQL,
    "op9_document_fingerprints": fingerprints.sql(),
    "op10_substring_dedup": substrings.SQL,
}

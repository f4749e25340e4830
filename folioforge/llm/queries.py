"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from folioforge.llm import embeddings, filters, html, jaccard, licenses, media, mixing, ngram, pieces, pii, quality, topk, whitening

QUERIES = {
    "op1_license_scan": licenses.query,
    "op2_jaccard_join": jaccard.query,
    "op3_mix_sources": mixing.query,
    "op4_media_columns": media.query,
    "op5_pii": pii.query,
    "op6_lm_scores": ngram.query,
    "op7_sentencepiece": pieces.query,
    "op8_embedding_dedup": embeddings.query,
    "op9_quality": quality.query,
    "op10_html_extraction": html.query,
    "op11_exact_topk": topk.query,
    "op12_whitening": whitening.query,
    "op13_filter_audit": filters.query,
}
ORACLES = {"op3_mix_sources": mixing.ORACLE, "op11_exact_topk": topk.ORACLE, "op13_filter_audit": filters.ORACLE}

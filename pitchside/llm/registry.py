"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import byte_bpe, html_text, imatch, license_scan, merkle, minhash, mixing, mixing_lm, routed_ann, toxicity, url_filter, vectors, whitening


def queries() -> dict:
    return {
        "op1_byte_bpe": byte_bpe.op1_byte_bpe,
        "op2_embedding_near_dedup": vectors.op2_embedding_near_dedup,
        "op3_license_scans": license_scan.op3_license_scans,
        "op4_lm_scoring": mixing_lm.op4_lm_scoring,
        "op5_url_filters": url_filter.op5_url_filters,
        "op6_html_extraction": html_text.op6_html_extraction,
        "op7_mixing_sources": mixing.op7_mixing_sources,
        "op8_document_fingerprints": imatch.op8_document_fingerprints,
        "op9_minhash_near_dedup": minhash.op9_minhash_near_dedup,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_approximate_neighbours": routed_ann.op13_approximate_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_url_filters": url_filter.OP5_SQL,
        "op7_mixing_sources": mixing.OP7_SQL,
        "op12_merkle_manifest": merkle.OP12_SQL,
    }

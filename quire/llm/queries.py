"""Queries of the corpus operators and, where SQL can express them, what they must equal."""

from __future__ import annotations

from . import decontam, hmm, jaccard, langid, packing, secrets, simhash, tokencount, urlfilter, warc

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_token_counts": tokencount.op2_token_counts,
    "op3_warc": warc.op3_warc,
    "op4_secret_scans": secrets.op4_secret_scans,
    "op5_document_fingerprints": simhash.op5_document_fingerprints,
    "op6_benchmark_decontamination": decontam.op6_benchmark_decontamination,
    "op7_lm_scoring": hmm.op7_lm_scoring,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_ngram_jaccard_join": jaccard.op9_ngram_jaccard_join,
    "op10_url_filters": urlfilter.op10_url_filters,
}

ORACLES = {
    "op3_warc": warc.ORACLE,
    "op9_ngram_jaccard_join": jaccard.ORACLE,
    "op10_url_filters": urlfilter.ORACLE,
}

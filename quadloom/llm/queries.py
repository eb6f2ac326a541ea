"""Queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

import corpus_pipeline
from quadloom.llm import decontaminate, fertility, licenses, mixture, ngram_join, ngram_model, passages, pseudonyms, token_files, warc

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_quality_rules": fertility.op4_quality_rules,
    "op5_warc_normalise": warc.op5_warc_normalise,
    "op6_pseudonyms": pseudonyms.op6_pseudonyms,
    "op7_lm_scores": ngram_model.op7_lm_scores,
    "op8_token_files": token_files.op8_token_files,
    "op9_mix_sources": mixture.op9_mix_sources,
    "op10_shared_passages": passages.op10_shared_passages,
    "pipeline": corpus_pipeline.run,
    "warc_read_back": warc.warc_read_back,
}

ORACLE: dict[str, str] = {"warc_read_back": warc.READ_BACK_SQL}

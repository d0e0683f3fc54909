"""Queries of this folder and their DuckDB SQL."""

from __future__ import annotations

from . import chat, decontam, lm, media, neardup, packing, quality, toxicity, urls, warc

QUERIES = {
    "op1_simhash_neardup": neardup.query,
    "op2_media_columns": media.query,
    "op3_url_filter": urls.query,
    "op4_lm_scoring": lm.query,
    "op5_warc_index": warc.query,
    "op6_quality_classifier": quality.query,
    "op7_best_fit_packing": packing.query,
    "op8_toxicity": toxicity.query,
    "op9_decontamination": decontam.query,
    "op10_chat_formatting": chat.query,
}

ORACLES: dict[str, str] = {
    "op5_warc_index": warc.SQL,
}

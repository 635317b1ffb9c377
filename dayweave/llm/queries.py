"""The registered queries of the numbered operators, and SQL where it can express them."""

from __future__ import annotations

from dayweave.llm import byte_bpe, chat, clusters, lines, pii, quality, resampling, simhash, substrings, toxicity, url_filter, warc, winnowing

QUERIES = {
    "op1_byte_bpe": byte_bpe.query,
    "op2_chat_format": chat.query,
    "op3_winnowing": winnowing.query,
    "op4_simhash": simhash.query,
    "op5_quality": quality.query,
    "op6_line_chunks": lines.query,
    "op7_substrings": substrings.query,
    "op8_toxicity": toxicity.query,
    "op9_warc": warc.query,
    "op10_url_filter": url_filter.query,
    "op11_centroids": clusters.query,
    "op12_pii": pii.query,
    "op13_resampling": resampling.query,
}
ORACLES = {"op2_chat_format": chat.ORACLE, "op5_quality": quality.ORACLE, "op6_line_chunks": lines.ORACLE, "op7_substrings": substrings.ORACLE, "op9_warc": warc.ORACLE, "op11_centroids": clusters.ORACLE}

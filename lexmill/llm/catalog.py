"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from lexmill.llm import chat, decontam, fim, htmltext, langid, minhash, multiindex, negatives, pieces, quality, toxicity, urls, warc

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_minhash_near_dedup": minhash.op2_minhash_near_dedup,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_chat_format": chat.op5_chat_format,
    "op6_url_filter": urls.op6_url_filter,
    "op6_url_filter_table": urls.op6_url_filter_table,
    "op7_language_id": langid.op7_language_id,
    "op8_warc": warc.op8_warc,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_html_text": htmltext.op10_html_text,
    "op11_nearest": multiindex.op11_nearest,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_fim": fim.op13_fim,
}
SQL = {
    "op1_quality_rules": quality.ORACLE,
    "op2_minhash_near_dedup": minhash.ORACLE,
    "op4_decontamination": decontam.ORACLE,
    "op5_chat_format": chat.ORACLE,
    "op6_url_filter": urls.ORACLE,
    "op8_warc": warc.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
    "op13_fim": fim.ORACLE,
}

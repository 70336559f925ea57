"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import chat, langid, linededup, pieces, simhash, substrings, topk, warc, wrappers, wumanber

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_simhash": simhash.op3_simhash,
    "op4_top_k": topk.op4_top_k,
    "op5_decontamination": wumanber.op5_decontamination,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_chat": chat.op7_chat,
    "op8_html": wrappers.op8_html,
    "op9_line_dedup": linededup.op9_line_dedup,
    "op10_warc": warc.op10_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op4_top_k": topk.OP4_SQL,
    "op5_decontamination": wumanber.OP5_SQL,
    "op6_substring_dedup": substrings.OP6_SQL,
    "op9_line_dedup": linededup.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
}

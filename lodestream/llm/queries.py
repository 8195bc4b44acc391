"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from lodestream.llm import byte_bpe, chat_format, fingerprints, html_text, line_dedup, mixing, near_dedup, packing, periodic_runs, quality, secret_scan, spelling, topk

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality": quality.op4_quality,
    "op5_topk": topk.op5_topk,
    "op6_html_text": html_text.op6_html_text,
    "op7_packing": packing.op7_packing,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_spelling": spelling.op11_spelling,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
ORACLES = {
    "op2_secret_scan": secret_scan.ORACLE,
    "op6_html_text": html_text.ORACLE,
    "op8_near_dedup": near_dedup.ORACLE,
    "op9_fingerprints": fingerprints.ORACLE,
    "op1_line_dedup": line_dedup.ORACLE,
    "op5_topk": topk.ORACLE,
    "op10_chat_format": chat_format.ORACLE,
    "op11_spelling": spelling.ORACLE,
}

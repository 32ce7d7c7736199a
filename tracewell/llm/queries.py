"""The numbered queries of the corpus operators, and the SQL that checks those SQL can express."""

from __future__ import annotations

from . import exact_dedup, exact_topk, html_text, line_dedup, mixing, near_dedup, packing, quality, source_audit, spelling, spotsigs, suffix_dedup, warc

QUERIES = {
    "op1_main_text": html_text.op1_main_text,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_quality": quality.op3_quality,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_spotsigs": spotsigs.op5_spotsigs,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_warc": warc.op7_warc,
    "op8_packing": packing.op8_packing,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_source_audit": source_audit.op11_source_audit,
    "op12_spelling": spelling.op12_spelling,
    "op13_exact_topk": exact_topk.op13_exact_topk,
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op4_mix_sources": mixing.ORACLE,
    "op7_warc": warc.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op11_source_audit": source_audit.ORACLE,
    "op13_exact_topk": exact_topk.ORACLE,
}

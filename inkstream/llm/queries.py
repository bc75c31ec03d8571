"""The registered queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from inkstream.llm import fim, phrases, substring_dedup, topk, warc
from inkstream.llm.bpe import op3_byte_bpe
from inkstream.llm.decontaminate import op9_decontaminate
from inkstream.llm.html_crf import op1_html_text
from inkstream.llm.lm_score import op2_cross_entropy
from inkstream.llm.near_dup import op8_near_dup
from inkstream.llm.piece_bpe import op12_piece_bpe
from inkstream.llm.quality import op7_quality
from inkstream.llm.secrets import op10_secret_scan

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_cross_entropy": op2_cross_entropy,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_warc": warc.op4_warc,
    "op5_exact_top_k": topk.op5_exact_top_k,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_quality": op7_quality,
    "op8_near_dup": op8_near_dup,
    "op9_decontaminate": op9_decontaminate,
    "op10_secret_scan": op10_secret_scan,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_piece_bpe": op12_piece_bpe,
    "op13_collocations": phrases.op13_collocations,
}

ORACLES: dict[str, str] = {"op4_warc": warc.ORACLE, "op5_exact_top_k": topk.ORACLE, "op6_substring_dedup": substring_dedup.ORACLE, "op11_fill_in_middle": fim.ORACLE, "op13_collocations": phrases.ORACLE}

"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from redline.llm.hashed_search import op4_hashed_search
from redline.llm.language import op2_language
from redline.llm.line_dedup import OP6_SQL, op6_line_dedup
from redline.llm.line_frequency import OP1_SQL, op1_line_frequency
from redline.llm.mixing import OP3_SQL, op3_mixing
from redline.llm.near_dup import OP5_SQL, op5_near_dup
from redline.llm.page_difference import op12_page_difference
from redline.llm.periodic_runs import OP11_SQL, op11_periodic_runs
from redline.llm.pieces import op7_sentencepiece
from redline.llm.ranked_search import OP13_SQL, op13_ranked_search
from redline.llm.sentence_spans import op8_sentence_spans
from redline.llm.toxicity import op10_toxicity
from redline.llm.url_filter import OP9_SQL, op9_url_filter

QUERIES = {
    "op1_line_frequency": op1_line_frequency,
    "op2_language": op2_language,
    "op3_mixing": op3_mixing,
    "op4_hashed_search": op4_hashed_search,
    "op5_near_dup": op5_near_dup,
    "op6_line_dedup": op6_line_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_sentence_spans": op8_sentence_spans,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_page_difference": op12_page_difference,
    "op13_ranked_search": op13_ranked_search,
}
ORACLES = {
    "op1_line_frequency": OP1_SQL,
    "op3_mixing": OP3_SQL,
    "op5_near_dup": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op9_url_filter": OP9_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op13_ranked_search": OP13_SQL,
}

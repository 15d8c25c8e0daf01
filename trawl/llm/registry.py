"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

import corpus_pipeline
from trawl.llm.op1_ans import op1_token_ids
from trawl.llm.op2_language import op2_language
from trawl.llm.op3_simhash import op3_simhash
from trawl.llm.op4_html import op4_html_text
from trawl.llm.op5_rules import op5_tree_rules
from trawl.llm.op6_mixing import ORACLE as MIXING_SQL
from trawl.llm.op6_mixing import op6_systematic
from trawl.llm.op7_lines import ORACLE as LINES_SQL
from trawl.llm.op7_lines import op7_line_runs
from trawl.llm.op8_packing import op8_best_fit
from trawl.llm.op9_topk import ORACLE as TOPK_SQL
from trawl.llm.op9_topk import op9_segment_topk
from trawl.llm.op10_quality import op10_byte_cnn
from trawl.llm.op11_repeats import op11_suffix_repeats
from trawl.llm.op12_phrases import ORACLE as PHRASES_SQL
from trawl.llm.op12_phrases import op12_collocations
from trawl.llm.op13_resampling import ORACLE as RESAMPLING_SQL
from trawl.llm.op13_resampling import op13_resampling


def queries() -> dict:
    found = [op1_token_ids, op2_language, op3_simhash, op4_html_text, op5_tree_rules, op6_systematic, op7_line_runs, op8_best_fit, op9_segment_topk, op10_byte_cnn, op11_suffix_repeats, op12_collocations, op13_resampling]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {"op6_systematic": MIXING_SQL, "op7_line_runs": LINES_SQL, "op9_segment_topk": TOPK_SQL, "op12_collocations": PHRASES_SQL, "op13_resampling": RESAMPLING_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

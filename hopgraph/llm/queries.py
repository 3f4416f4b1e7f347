"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from hopgraph.llm.chat import OP4_SQL, op4_chat_format
from hopgraph.llm.decontamination import op5_decontamination
from hopgraph.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from hopgraph.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from hopgraph.llm.language_id import op11_language_id
from hopgraph.llm.line_dedup import OP3_SQL, op3_line_dedup
from hopgraph.llm.lm_scoring import op8_lm_scoring
from hopgraph.llm.mixing import OP2_SQL, op2_source_mix
from hopgraph.llm.periodic_runs import op13_periodic_runs
from hopgraph.llm.pii import op6_personal_data
from hopgraph.llm.simhash import op1_simhash
from hopgraph.llm.substring_dedup import op7_substring_dedup
from hopgraph.llm.toxicity import op9_toxicity

QUERIES = {
    "op8_lm_scoring": op8_lm_scoring,
    "op7_substring_dedup": op7_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_personal_data": op6_personal_data,
    "op9_toxicity": op9_toxicity,
    "op1_simhash": op1_simhash,
    "op2_source_mix": op2_source_mix,
    "op3_line_dedup": op3_line_dedup,
    "op4_chat_format": op4_chat_format,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_language_id": op11_language_id,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES = {
    "op2_source_mix": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op4_chat_format": OP4_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op12_hard_negatives": OP12_SQL,
}

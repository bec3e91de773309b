"""Queries of the corpus operators and their SQL, by name; __spark_entry__.py adds them when this subpackage is there."""

from __future__ import annotations

from siftloom.llm.jaccard import op4_jaccard_join
from siftloom.llm.mixing import OP5_SQL, op5_mixing
from siftloom.llm.neighbours import op8_neighbours
from siftloom.llm.packing import op10_packing
from siftloom.llm.quality_model import op6_quality_classifier
from siftloom.llm.quality_rules import OP2_SQL, op2_quality_rules
from siftloom.llm.suffixes import op9_suffix_dedup
from siftloom.llm.token_counts import op3_token_counts
from siftloom.llm.toxicity import op1_toxicity
from siftloom.llm.warc import op7_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_counts": op3_token_counts,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_mixing": op5_mixing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_warc": op7_warc,
    "op8_neighbours": op8_neighbours,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": OP2_SQL,
    "op5_mixing": OP5_SQL,
}

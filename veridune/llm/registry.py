"""Queries of this package and their SQL."""

from __future__ import annotations

from . import op01_suffix_dedup as o1
from . import op02_topk as o2
from . import op03_simhash as o3
from . import op04_secret_scan as o4
from . import op05_automaton_dedup as o5
from . import op06_quality_rules as o6
from . import op07_sentencepiece as o7
from . import op08_token_files as o8
from . import op09_best_fit_packing as o9
from . import op10_line_dedup as o10

QUERIES = {
    "op1_suffix_array_dedup": o1.op1_suffix_array_dedup,
    "op2_exact_topk": o2.op2_exact_topk,
    "op3_simhash_near_dedup": o3.op3_simhash_near_dedup,
    "op4_secret_scan": o4.op4_secret_scan,
    "op5_substring_dedup": o5.op5_substring_dedup,
    "op6_quality_rules": o6.op6_quality_rules,
    "op7_sentencepiece": o7.op7_sentencepiece,
    "op8_token_files": o8.op8_token_files,
    "op9_best_fit_packing": o9.op9_best_fit_packing,
    "op10_line_dedup": o10.op10_line_dedup,
}
SQL: dict[str, str] = {"op2_exact_topk": o2.SQL, "op6_quality_rules": o6.SQL, "op10_line_dedup": o10.SQL}

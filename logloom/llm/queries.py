"""The queries of this folder, by name, and the SQL of those that SQL expresses."""

from __future__ import annotations

from . import decontaminate, katz, language, licenses, mixing, near_dedup, nearest, substring_dedup, suffix_dedup, token_counts

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_nearest": nearest.op2_nearest,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_language": language.op8_language,
    "op9_licenses": licenses.op9_licenses,
    "op10_katz": katz.op10_katz,
}
SQL = {"op1_mix": mixing.SQL, "op9_licenses": licenses.SQL}

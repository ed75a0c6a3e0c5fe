"""What `__spark_entry__.py` registers from this subpackage."""

from __future__ import annotations

from . import ann, jaccard, licenses, lines, mixing, packing, substring, token_counts, topk, toxicity

QUERIES = {f.__name__: f for f in (packing.op1_packing, token_counts.op2_token_counts, toxicity.op5_toxicity, jaccard.op9_ngram_jaccard, lines.op8_line_dedup, mixing.op6_mixing, topk.op7_exact_topk, ann.op4_ann, licenses.op10_license_scan, substring.op3_substring_dedup)}
ORACLES: dict[str, str] = {"op6_mixing": mixing.oracle(), "op7_exact_topk": topk.ORACLE}

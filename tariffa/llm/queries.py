"""The registered queries of the training-data operators: name to (function, SQL or None)."""

from __future__ import annotations

from tariffa.llm import (
    decontamination, exact_dedup, fill_in_middle, html_extract, lm_scoring, packing, periodic_runs, pii, quality, simhash_dedup, substring_dedup,
    toxicity, url_filter,
)

Q = {
    "op1_html_extraction": (html_extract.op1_html_extraction, None),
    "op2_toxicity": (toxicity.op2_toxicity, None),
    "op3_exact_dedup": (exact_dedup.op3_exact_dedup, exact_dedup.SQL),
    "op4_packing": (packing.op4_packing, None),
    "op5_substring_dedup": (substring_dedup.op5_substring_dedup, substring_dedup.SQL),
    "op6_simhash_dedup": (simhash_dedup.op6_simhash_dedup, None),
    "op7_url_filter": (url_filter.op7_url_filter, url_filter.SQL),
    "op8_quality_classifier": (quality.op8_quality_classifier, None),
    "op9_lm_scoring": (lm_scoring.op9_lm_scoring, None),
    "op10_decontamination": (decontamination.op10_decontamination, decontamination.SQL),
    "op11_pii": (pii.op11_pii, None),
    "op12_fill_in_middle": (fill_in_middle.op12_fill_in_middle, fill_in_middle.SQL),
    "op13_periodic_runs": (periodic_runs.op13_periodic_runs, None),
}

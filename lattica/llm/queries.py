"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import op1_quality, op2_simhash, op3_ann, op4_sharding, op5_chat, op6_urls, op7_licenses, op8_toxicity, op9_packing, op10_mixing, op11_substrings, op12_alignment, op13_phrases

QUERIES = {
    "op1_quality": op1_quality.query,
    "op2_simhash": op2_simhash.query,
    "op3_ann": op3_ann.query,
    "op4_sharding": op4_sharding.query,
    "op5_chat": op5_chat.query,
    "op6_urls": op6_urls.query,
    "op7_licenses": op7_licenses.query,
    "op8_toxicity": op8_toxicity.query,
    "op9_packing": op9_packing.query,
    "op10_mixing": op10_mixing.query,
    "op11_substrings": op11_substrings.query,
    "op12_alignment": op12_alignment.query,
    "op13_phrases": op13_phrases.query,
}
ORACLE = {"op1_quality": op1_quality.ORACLE, "op5_chat": op5_chat.ORACLE, "op6_urls": op6_urls.ORACLE, "op7_licenses": op7_licenses.ORACLE, "op11_substrings": op11_substrings.ORACLE, "op13_phrases": op13_phrases.ORACLE}

"""Registered queries of this subpackage: name -> (callable(spark, sf_dir), oracle SQL or None)."""

from __future__ import annotations

from wayline.llm import decontam, jaccardjoin, langid, licences, lmscore, middle, neardup, neighbours, packing, pii, quality, substring, vectorcodes

QUERIES = {
    "op1_language_id": (langid.op1_language_id, None),
    "op2_lm_scoring": (lmscore.op2_lm_scoring, None),
    "op3_licence_scan": (licences.op3_licence_scan, licences.ORACLE),
    "op4_substring_dedup": (substring.op4_substring_dedup, None),
    "op5_block_ann": (neighbours.op5_block_ann, neighbours.ORACLE),
    "op6_pii": (pii.op6_pii, None),
    "op7_benchmark_decontamination": (decontam.op7_benchmark_decontamination, None),
    "op8_bestfit_packing": (packing.op8_bestfit_packing, None),
    "op9_minhash_neardup": (neardup.op9_minhash_neardup, None),
    "op10_quality_classifier": (quality.op10_quality_classifier, None),
    "op11_fill_in_middle": (middle.op11_fill_in_middle, middle.ORACLE),
    "op12_jaccard_join": (jaccardjoin.op12_jaccard_join, jaccardjoin.ORACLE),
    "op13_vector_codes": (vectorcodes.op13_vector_codes, vectorcodes.ORACLE),
}

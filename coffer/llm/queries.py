"""The training-data queries by name, and the SQL of those that it can express; tests hold the others against brute force."""

from coffer.llm import bestfit, decontaminate, language, mixture, neighbours, privacy, quality, simhash, suffix, toxicity
from coffer.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]

QUERIES = {
    "op1_best_fit_packing": bestfit.op1,
    "op2_mixture_packing": mixture.op2,
    "op3_repeated_strings": suffix.op3,
    "op4_quality_neighbours": quality.op4,
    "op5_string_tiling": decontaminate.op5,
    "op6_simhash_segments": simhash.op6,
    "op7_personal_data": privacy.op7,
    "op8_tree_neighbours": neighbours.op8,
    "op9_byte_convolution": language.op9,
    "op10_toxic_segments": toxicity.op10,
}

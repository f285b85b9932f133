"""The queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_pairs import op9_byte_pairs
from .contamination import op1_decontaminate
from .disclosure import op12_private_data
from .fingerprints import op8_fingerprints
from .lattice_lm import op7_lattice
from .licenses import op2_licenses
from .near_duplicates import op3_near_duplicates
from .oracles import ORACLES  # noqa: F401
from .prefix_trie import op11_prefix_trie
from .quality import op5_quality
from .recompression import op6_recompression
from .residue_search import op13_hard_negatives
from .suffix_dedup import op10_suffix_array
from .toxicity import op4_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_licenses": op2_licenses,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_recompression": op6_recompression,
    "op7_lattice": op7_lattice,
    "op8_fingerprints": op8_fingerprints,
    "op9_byte_pairs": op9_byte_pairs,
    "op10_suffix_array": op10_suffix_array,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_private_data": op12_private_data,
    "op13_hard_negatives": op13_hard_negatives,
}


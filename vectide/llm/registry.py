"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from .byte_bpe import op7_byte_bpe
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .fingerprints import op10_fingerprints
from .licenses import op4_licenses
from .near_dedup import op2_near_dedup
from .packing import op1_packing
from .quality import op9_quality
from .substring_dedup import op6_substring_dedup
from .toxicity import op3_toxicity
from .url_filter import op5_url_filter

QUERIES = {
    "op1_packing": op1_packing,
    "op2_near_dedup": op2_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_licenses": op4_licenses,
    "op5_url_filter": op5_url_filter,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality": op9_quality,
    "op10_fingerprints": op10_fingerprints,
}

ORACLE_SQL = {"op8_exact_dedup": OP8_SQL}

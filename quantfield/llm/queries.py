"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .language import op5_language
from .mixing import OP4_SQL, op4_mixing
from .near_duplicates import op7_near_duplicates
from .packing import op3_packing
from .quality import OP8_SQL, op8_quality
from .repeats import op6_repeats
from .token_output import op2_token_output
from .top_k import OP9_SQL, op9_top_k
from .toxicity import op1_toxicity
from .urls import OP10_SQL, op10_url_filters

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_output": op2_token_output,
    "op3_packing": op3_packing,
    "op4_mixing": op4_mixing,
    "op5_language": op5_language,
    "op6_repeats": op6_repeats,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_quality": op8_quality,
    "op9_top_k": op9_top_k,
    "op10_url_filters": op10_url_filters,
}
ORACLES = {"op4_mixing": OP4_SQL, "op8_quality": OP8_SQL, "op9_top_k": OP9_SQL, "op10_url_filters": OP10_SQL}

"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tidewheel.llm.fingerprints import OP8_SQL, op8_fingerprints
from tidewheel.llm.language import op9_language_id
from tidewheel.llm.mixing import OP5_SQL, op5_mixing
from tidewheel.llm.near_duplicates import op7_near_duplicates
from tidewheel.llm.neighbours import op4_neighbours
from tidewheel.llm.packing import op2_packing
from tidewheel.llm.quality import op1_quality
from tidewheel.llm.repeats import OP3_SQL, op3_repeats
from tidewheel.llm.token_counts import op6_token_counts
from tidewheel.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_repeats": op3_repeats,
    "op4_neighbours": op4_neighbours,
    "op5_mixing": op5_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_fingerprints": op8_fingerprints,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {"op3_repeats": OP3_SQL, "op5_mixing": OP5_SQL, "op8_fingerprints": OP8_SQL}

"""The queries of this subpackage and, where SQL can express them, the SQL for the same rows."""

from __future__ import annotations

from .op1_line_dedup import op1_line_dedup
from .op10_language_id import op10_language_id
from .op11_pitman_yor import op11_pitman_yor
from .op12_collocations import op12_collocations
from .op13_periodic_runs import op13_periodic_runs
from .op2_substring_dedup import op2_substring_dedup
from .op3_nearest import op3_nearest
from .op4_decontamination import op4_decontamination
from .op5_toxicity import op5_toxicity
from .op6_minhash import op6_minhash
from .op7_chat_format import OP7_SQL, op7_chat_format
from .op8_packing import op8_packing
from .op9_suffix_array import op9_suffix_array
from .sql import OP2_SQL, OP6_SQL, OP9_SQL, OP12_SQL, OP13_SQL

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_nearest": op3_nearest,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_minhash": op6_minhash,
    "op7_chat_format": op7_chat_format,
    "op8_packing": op8_packing,
    "op9_suffix_array": op9_suffix_array,
    "op10_language_id": op10_language_id,
    "op11_pitman_yor": op11_pitman_yor,
    "op12_collocations": op12_collocations,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op6_minhash": OP6_SQL,
    "op7_chat_format": OP7_SQL,
    "op9_suffix_array": OP9_SQL,
    "op12_collocations": OP12_SQL,
    "op13_periodic_runs": OP13_SQL,
}

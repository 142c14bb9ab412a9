"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from .ans import op1_rans_tokens
from .chat import ORACLE_OP10, op10_prefix_targets
from .contamination import op7_template_decontamination
from .lines import op6_fuzzy_lines
from .packing import op4_pattern_packing
from .quality import op9_factorisation_machine
from .repeats import op8_relative_parsing
from .sharding import op2_hypergeometric_shards
from .simhash import op5_simhash_pigeonhole
from .sketch import op3_scaled_sketch

QUERIES = {
    "op1_rans_tokens": op1_rans_tokens,
    "op2_hypergeometric_shards": op2_hypergeometric_shards,
    "op3_scaled_sketch": op3_scaled_sketch,
    "op4_pattern_packing": op4_pattern_packing,
    "op5_simhash_pigeonhole": op5_simhash_pigeonhole,
    "op6_fuzzy_lines": op6_fuzzy_lines,
    "op7_template_decontamination": op7_template_decontamination,
    "op8_relative_parsing": op8_relative_parsing,
    "op9_factorisation_machine": op9_factorisation_machine,
    "op10_prefix_targets": op10_prefix_targets,
}

ORACLES = {"op10_prefix_targets": ORACLE_OP10}

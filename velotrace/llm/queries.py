"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from .decontamination import OP5_SQL, op5_benchmark_decontamination
from .html_text import op10_html_text
from .line_dedup import OP2_SQL, op2_line_dedup
from .packing import op3_best_fit_packing
from .quality import op6_quality_rules
from .sharding import op9_histogram_sharding
from .simhash import op4_simhash_near_dedup
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .token_files import op7_token_files
from .toxicity import op8_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_line_dedup,
        op3_best_fit_packing,
        op4_simhash_near_dedup,
        op5_benchmark_decontamination,
        op6_quality_rules,
        op7_token_files,
        op8_toxicity,
        op9_histogram_sharding,
        op10_html_text,
    )
}
ORACLE_SQL = {"op1_substring_dedup": OP1_SQL, "op2_line_dedup": OP2_SQL, "op5_benchmark_decontamination": OP5_SQL}

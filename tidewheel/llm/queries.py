"""The corpus operators as queries, with DuckDB SQL where it can express them."""

from tidewheel.llm.ann import op3_ann
from tidewheel.llm.language_id import op2_language_id
from tidewheel.llm.mixing import OP9_SQL, op9_mixing
from tidewheel.llm.packing import op10_packing
from tidewheel.llm.quality_classifier import op8_quality_classifier
from tidewheel.llm.quality_rules import OP5_SQL, op5_quality_rules
from tidewheel.llm.secret_scan import OP1_SQL, op1_secret_scan
from tidewheel.llm.simhash import op6_simhash
from tidewheel.llm.substring_dedup import op4_substring_dedup
from tidewheel.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_language_id": op2_language_id,
    "op3_ann": op3_ann,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
}
ORACLE_SQL = {
    "op1_secret_scan": OP1_SQL,
    "op5_quality_rules": OP5_SQL,
    "op9_mixing": OP9_SQL,
}

"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from eralith.llm.bpe import op5_bpe
from eralith.llm.filter_audit import op13_filter_audit
from eralith.llm.fingerprint import op3_fingerprint
from eralith.llm.infilling import op11_fill_in_middle
from eralith.llm.license_scan import op10_license_scan
from eralith.llm.lm_scoring import op2_lm_scoring
from eralith.llm.ngram_join import op4_ngram_join
from eralith.llm.oracles import ORACLE_SQL
from eralith.llm.packing import op9_best_fit_packing
from eralith.llm.quality_rules import op7_quality_rules
from eralith.llm.secret_scan import op8_secret_scan
from eralith.llm.sharding import op12_sharding
from eralith.llm.substring_dedup import op1_substring_dedup
from eralith.llm.suffix_dedup import op6_suffix_dedup

#: ORACLE_SQL leaves out those for which SQL is too slow on whole tables or cannot express the method (see tests/llm).
__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_lm_scoring, op3_fingerprint, op4_ngram_join, op5_bpe, op6_suffix_dedup, op7_quality_rules,
        op8_secret_scan, op9_best_fit_packing, op10_license_scan, op11_fill_in_middle, op12_sharding, op13_filter_audit,
    )
}

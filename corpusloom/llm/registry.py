"""The queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from .op10_pack import op10_best_fit_packing
from .op11_resample import SQL as OP11_SQL
from .op11_resample import op11_importance_resampling
from .op12_balance import op12_cost_balanced_packing
from .op13_trie import SQL as OP13_SQL
from .op13_trie import op13_conversation_trie
from .op1_wavelet import op1_wavelet_tokens
from .op2_minhash import SQL as OP2_SQL
from .op2_minhash import op2_near_duplicates
from .op3_fm import op3_quality_classifier
from .op4_suffix import op4_suffix_dedup
from .op5_quality import op5_quality_rules
from .op6_lines import SQL as OP6_SQL
from .op6_lines import op6_line_dedup
from .op7_bpe import op7_bpe_roundtrip
from .op8_warc import SQL as OP8_SQL
from .op8_warc import op8_warc_revisits
from .op9_search import SQL as OP9_SQL
from .op9_search import op9_top_k_search

QUERIES = {
    "op1_wavelet_tokens": op1_wavelet_tokens,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_bpe_roundtrip": op7_bpe_roundtrip,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_top_k_search": op9_top_k_search,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_cost_balanced_packing": op12_cost_balanced_packing,
    "op13_conversation_trie": op13_conversation_trie,
}

SQL: dict[str, str] = {
    "op2_near_duplicates": OP2_SQL,
    "op6_line_dedup": OP6_SQL,
    "op8_warc_revisits": OP8_SQL,
    "op9_top_k_search": OP9_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op13_conversation_trie": OP13_SQL,
}

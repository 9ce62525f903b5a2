"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op6_token_counts, op10_bpe
from .chat import op7_chat_format
from .decontaminate import op3_benchmark_decontamination
from .licenses import op9_license_scan
from .neardup import op4_minhash_near_dedup
from .quality import op1_quality_rules
from .resampling import op12_importance_resampling
from .secrets import op2_secret_scan
from .sharding import op8_minimax_sharding
from .sql import ORACLES as ORACLES
from .substring import op5_substring_dedup
from .suffixes import op11_suffix_dedup
from .whitening import op13_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_secret_scan,
        op3_benchmark_decontamination,
        op4_minhash_near_dedup,
        op5_substring_dedup,
        op6_token_counts,
        op7_chat_format,
        op8_minimax_sharding,
        op9_license_scan,
        op10_bpe,
        op11_suffix_dedup,
        op12_importance_resampling,
        op13_embedding_whitening,
    )
}

"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .centroid_clustering import OP13_SQL, op13_centroid_clustering
from .embedding_dedup import OP5_SQL, op5_embedding_dedup
from .language_id import op11_language_id
from .lm_scoring import op4_lm_scoring
from .mixing import OP2_SQL, op2_mixing
from .packing import op9_best_fit_packing
from .quality_classifier import op3_quality_classifier
from .quality_rules import OP8_SQL, op8_quality_rules
from .simhash import op7_simhash
from .substring_dedup import OP6_SQL, op6_substring_dedup
from .token_counts import op1_token_counts
from .token_files import op10_token_files
from .vector_codes import OP12_SQL, op12_vector_codes

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_mixing, op3_quality_classifier, op4_lm_scoring, op5_embedding_dedup, op6_substring_dedup,
        op7_simhash, op8_quality_rules, op9_best_fit_packing, op10_token_files, op11_language_id, op12_vector_codes, op13_centroid_clustering,
    )
}

#: The other queries need a tokenizer, a trained model or a hash that SQL doesn't have: they
#: are tested against brute-force versions instead.
ORACLE_SQL: dict[str, str] = {
    "op2_mixing": OP2_SQL,
    "op5_embedding_dedup": OP5_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op8_quality_rules": OP8_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_centroid_clustering": OP13_SQL,
}

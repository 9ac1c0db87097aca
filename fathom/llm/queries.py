"""Queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .exact_topk import OP6_SQL, op6_exact_topk
from .jaccard_join import op7_ngram_jaccard_join
from .language_id import op3_language_id
from .packing import op1_best_fit_packing
from .quality_classifier import op9_quality_classifier
from .quality_rules import op8_quality_rules
from .sentencepiece_codec import op5_sentencepiece
from .sharding import op4_sharding
from .suffix_dedup import op10_suffix_array_dedup
from .toxicity import op2_toxicity


def queries() -> dict:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_toxicity, op3_language_id, op4_sharding, op5_sentencepiece, op6_exact_topk, op7_ngram_jaccard_join, op8_quality_rules, op9_quality_classifier, op10_suffix_array_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_topk": OP6_SQL}

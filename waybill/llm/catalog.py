"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline

from .op1_decontaminate import op1_leaks
from .op10_jaccard import op10_jaccard
from .op11_importance import OP11_SQL, op11_importance
from .op12_simhash import op12_simhash
from .op13_fim import OP13_SQL, op13_fim
from .op2_html import op2_main_text
from .op3_secrets import op3_secrets
from .op4_quality import OP4_SQL, op4_quality
from .op5_pack import op5_packing
from .op6_suffix import op6_suffixes
from .op7_hmm import op7_scores
from .op8_substring import OP8_SQL, op8_substrings
from .op9_shard import op9_shards

QUERIES = {
    "op1_leaks": op1_leaks,
    "op2_main_text": op2_main_text,
    "op3_secrets": op3_secrets,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_suffixes": op6_suffixes,
    "op7_scores": op7_scores,
    "op8_substrings": op8_substrings,
    "op9_shards": op9_shards,
    "op10_jaccard": op10_jaccard,
    "op11_importance": op11_importance,
    "op12_simhash": op12_simhash,
    "op13_fim": op13_fim,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op4_quality": OP4_SQL,
    "op8_substrings": OP8_SQL,
    "op11_importance": OP11_SQL,
    "op13_fim": OP13_SQL,
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
}

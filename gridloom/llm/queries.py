"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from gridloom.llm import mix_sources, quality_rules, topk_search
from gridloom.llm.best_fit_pack import op8_best_fit_pack
from gridloom.llm.language_id import op6_language_id
from gridloom.llm.license_scan import op1_license_scan
from gridloom.llm.mix_sources import op4_mix_sources
from gridloom.llm.quality_rules import op9_quality_rules
from gridloom.llm.secret_scan import op5_secret_scan
from gridloom.llm.simhash_dedup import op2_simhash_near_dedup
from gridloom.llm.token_counts import op7_token_counts
from gridloom.llm.topk_search import op10_maxscore_top_k
from gridloom.llm.toxicity import op3_toxicity_nnpu

QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_simhash_near_dedup, op3_toxicity_nnpu, op4_mix_sources, op5_secret_scan, op6_language_id,
        op7_token_counts, op8_best_fit_pack, op9_quality_rules, op10_maxscore_top_k,
    )
}
ORACLE_SQL = mix_sources.ORACLE_SQL | quality_rules.ORACLE_SQL | topk_search.ORACLE_SQL

"""Queries of this subpackage over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
from paperlens.llm.langid import op4_language_mixture
from paperlens.llm.lines import OP9_SQL, op9_winnowed_lines
from paperlens.llm.minhash import op13_bayesian_minhash
from paperlens.llm.mixing import op6_hash_threshold_mix
from paperlens.llm.packing import op2_best_fit_packing
from paperlens.llm.recompress import OP5_SQL, op5_recompression_dedup
from paperlens.llm.sharding import op1_hypergeometric_shuffle
from paperlens.llm.simhash import op3_simhash_components
from paperlens.llm.suffixes import OP10_SQL, op10_suffix_family_dedup
from paperlens.llm.topk import OP7_SQL, op7_block_pruned_search
from paperlens.llm.variants import op11_spelling_variants
from paperlens.llm.weighted import op8_weighted_fingerprints
from paperlens.llm.whitening import op12_shifted_cholesky_whitening

QUERIES = {f.__name__: f for f in (
    op1_hypergeometric_shuffle, op2_best_fit_packing, op3_simhash_components,
    op4_language_mixture, op5_recompression_dedup, op6_hash_threshold_mix, op7_block_pruned_search,
    op8_weighted_fingerprints, op9_winnowed_lines, op10_suffix_family_dedup,
    op11_spelling_variants, op12_shifted_cholesky_whitening, op13_bayesian_minhash)}

QUERIES["pipeline"] = corpus_pipeline.run

ORACLES = {
    "op5_recompression_dedup": OP5_SQL,
    "op7_block_pruned_search": OP7_SQL,
    "op9_winnowed_lines": OP9_SQL,
    "op10_suffix_family_dedup": OP10_SQL,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

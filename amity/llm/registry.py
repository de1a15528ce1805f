"""Registered queries of this subpackage and the SQL of those SQL can express."""

from __future__ import annotations

import corpus_pipeline
from amity.llm.decontamination import OP12_SQL, op12_benchmark_decontamination
from amity.llm.fingerprints import op6_document_fingerprints
from amity.llm.language_id import op8_language_id
from amity.llm.license_scan import OP5_SQL, op5_license_scan
from amity.llm.lexical_search import OP13_SQL, op13_ranked_lexical_search
from amity.llm.line_dedup import OP7_SQL, op7_line_dedup
from amity.llm.mixing import op9_source_mixing
from amity.llm.packing import op1_best_fit_packing
from amity.llm.quality_rules import OP10_SQL, op10_quality_rules
from amity.llm.simhash import op2_simhash_near_dedup
from amity.llm.spelling_variants import op11_spelling_variants
from amity.llm.substring_dedup import op4_substring_dedup
from amity.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_line_dedup": op7_line_dedup,
    "op8_language_id": op8_language_id,
    "op9_source_mixing": op9_source_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_benchmark_decontamination": op12_benchmark_decontamination,
    "op13_ranked_lexical_search": op13_ranked_lexical_search,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op5_license_scan": OP5_SQL,
    "op7_line_dedup": OP7_SQL,
    "op10_quality_rules": OP10_SQL,
    "op12_benchmark_decontamination": OP12_SQL,
    "op13_ranked_lexical_search": OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL

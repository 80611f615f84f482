"""The queries of this subpackage: ``opN_<name>`` applied to whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm.bpe import op9_byte_bpe
from sheaf.llm.decontaminate import op3_decontamination
from sheaf.llm.html_main import op6_html_extraction
from sheaf.llm.jaccard_join import op10_ngram_jaccard
from sheaf.llm.language_model import op4_lm_scoring
from sheaf.llm.line_dedup import op2_line_dedup
from sheaf.llm.piece_bpe import op12_piece_bpe
from sheaf.llm.quality_classifier import op8_quality_classifier
from sheaf.llm.quality_rules import op1_quality_rules
from sheaf.llm.source_audit import op11_source_audit
from sheaf.llm.spelling import op13_spelling_variants
from sheaf.llm.sql import ORACLES
from sheaf.llm.substring_dedup import op5_substring_dedup
from sheaf.llm.toxicity import op7_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_line_dedup, op3_decontamination, op4_lm_scoring, op5_substring_dedup, op6_html_extraction, op7_toxicity, op8_quality_classifier, op9_byte_bpe, op10_ngram_jaccard, op11_source_audit, op12_piece_bpe, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in queries()}

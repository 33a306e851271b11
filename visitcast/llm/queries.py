"""The registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (bpe, collocations, decontaminate, filter_audit, html_text, mlm_score, oracles, quality_fm, quality_rules, sharding,
               simhash_dedup, suffix_dedup, toxicity_cnn, url_templates)
from .common import show_workers_the_package


OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_fm": quality_fm.op1_quality_fm,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_simhash_dedup": simhash_dedup.op3_simhash_dedup,
    "op4_html_text": html_text.op4_html_text,
    "op6_toxicity_cnn": toxicity_cnn.op6_toxicity_cnn,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_masked_lm": mlm_score.op8_masked_lm,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_url_filter": url_templates.op10_url_filter,
    "op11_collocations": collocations.op11_collocations,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_jump_shards": sharding.op13_jump_shards,
}


def _registered(operator):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        show_workers_the_package(spark)
        return operator(spark, sf_dir)

    query.__name__, query.__doc__ = operator.__name__, operator.__doc__
    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _registered(operator) for name, operator in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()

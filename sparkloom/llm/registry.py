"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from sparkloom.llm import ann, decontaminate, kneser_ney, lines, packing, simhash, substring, toxicity, urls, warc


def queries() -> dict:
    """Name -> callable(spark, sf_dir)."""
    return {
        "pipeline": corpus_pipeline.run,
        "op1_simhash": simhash.op1_simhash,
        "op2_line_spread": lines.op2_line_spread,
        "op3_decontamination": decontaminate.op3_decontamination,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_warc": warc.op6_warc,
        "op7_url_rules": urls.op7_url_rules,
        "op8_passages": substring.op8_passages,
        "op9_prefix_forest": ann.op9_prefix_forest,
        "op10_kneser_ney": kneser_ney.op10_kneser_ney,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL, where SQL can express the query on whole tables."""
    return {
        "op2_line_spread": lines.OP2_SQL,
        "op6_warc": warc.OP6_SQL,
    }

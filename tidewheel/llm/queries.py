"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, license_scan, lm_scoring, near_dedup, packing, pii, quality_classifier, quality_rules, substring_dedup, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": token_counts.op1,
        "op2_near_dedup": near_dedup.op2,
        "op3_quality_classifier": quality_classifier.op3,
        "op4_lm_scoring": lm_scoring.op4,
        "op5_substring_dedup": substring_dedup.op5,
        "op6_license_scan": license_scan.op6,
        "op7_packing": packing.op7,
        "op8_quality_rules": quality_rules.op8,
        "op9_decontamination": decontamination.op9,
        "op10_pii": pii.op10,
    }

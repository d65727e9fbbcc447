"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from sqlverdict.llm import bpe, exact_dedup, hmm, line_dedup, lpf, near_dup, packing, pii, quality, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing.op1_packing,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_near_dup": near_dup.op3_near_dup,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_pii": pii.op5_pii,
        "op6_repeats": lpf.op6_repeats,
        "op7_hmm": hmm.op7_hmm,
        "op8_bpe": bpe.op8_bpe,
        "op9_quality": quality.op9_quality,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.OP4_SQL, "op10_line_dedup": line_dedup.OP10_SQL}

"""Registered queries of the package and, where SQL can say the same, the SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import bpe, dialogs, exact, html_text, jaccard, lines, maxent, merkle, mixing, periodic, quality, secrets, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_min_cut": html_text.op1_min_cut,
    "op2_blob_ledger": secrets.op2_blob_ledger,
    "op3_line_hashing": lines.op3_line_hashing,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_maxent": maxent.op5_maxent,
    "op6_mixing": mixing.op6_mixing,
    "op7_merkle": merkle.op7_merkle,
    "op8_block_naming": exact.op8_block_naming,
    "op9_signature_trees": jaccard.op9_signature_trees,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_suffix_dawg": dialogs.op11_suffix_dawg,
    "op12_run_detection": periodic.op12_run_detection,
    "op13_line_rules": quality.op13_line_rules,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op8_block_naming": exact.ORACLE,
    "op13_line_rules": quality.ORACLE,
}

"""The registered queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op5_prefix_bpe
from .language import op13_byte_cnn
from .line_crf import op2_line_crf
from .merkle import op12_merkle_manifest
from .oracles import MERKLE, RESAMPLING
from .ordinal import op9_ordinal_toxicity
from .packing import op7_best_fit
from .quality_eb import op1_empirical_bayes
from .resampling import op11_bracketed_resampling
from .sharding import op8_virtual_slots
from .simhash import op4_simhash
from .sstable import op3_sstable
from .substring import op6_doubling
from .topk import op10_impact_ordered


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_empirical_bayes": op1_empirical_bayes,
        "op2_line_crf": op2_line_crf,
        "op3_sstable": op3_sstable,
        "op4_simhash": op4_simhash,
        "op5_prefix_bpe": op5_prefix_bpe,
        "op6_doubling": op6_doubling,
        "op7_best_fit": op7_best_fit,
        "op8_virtual_slots": op8_virtual_slots,
        "op9_ordinal_toxicity": op9_ordinal_toxicity,
        "op10_impact_ordered": op10_impact_ordered,
        "op11_bracketed_resampling": op11_bracketed_resampling,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_byte_cnn": op13_byte_cnn,
    }


def oracle_sql() -> dict[str, str]:
    """The others can't be said in DuckDB's SQL: tests/llm holds each against a brute-force version."""
    return {"op11_bracketed_resampling": RESAMPLING, "op12_merkle_manifest": MERKLE}

"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rfmlens.llm import (decontam, html, langid, licenses, lm, neardup, pieces, quality, resample, shards, topk, tries,
                         warc)
from rfmlens.llm.common import shared_code


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_warc": warc.op1_warc,
        "op2_topk": topk.op2_topk,
        "op3_lm": lm.op3_lm,
        "op4_minhash": neardup.op4_minhash,
        "op5_quality": quality.op5_quality,
        "op6_langid": langid.op6_langid,
        "op7_html": html.op7_html,
        "op8_licenses": licenses.op8_licenses,
        "op9_pieces": pieces.op9_pieces,
        "op10_decontamination": decontam.op10_decontamination,
        "op11_sharding": shards.op11_sharding,
        "op12_resampling": resample.op12_resampling,
        "op13_prefix_trie": tries.op13_prefix_trie,
    }
    return {name: shared_code(run) for name, run in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.OP1_SQL,
        "op2_topk": topk.OP2_SQL,
        "op8_licenses": licenses.OP8_SQL,
        "op10_decontamination": decontam.OP10_SQL,
    }

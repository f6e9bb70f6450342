"""Registered queries of the training-data operators, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, html_blocks, langid, mixing, neardup, pii, quality, tokenbin, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_semi_markov_pii": pii.op1,
        "op2_raking_mix": mixing.op2,
        "op3_block_labeller": html_blocks.op3,
        "op4_gru_language": langid.op4,
        "op5_conv_quality": quality.op5,
        "op6_chat_format": chat.op6,
        "op7_pivot_topk": topk.op7,
        "op8_bagminhash": neardup.op8,
        "op9_token_shards": tokenbin.op9,
        "op10_decontaminate": decontam.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_raking_mix": mixing.sql(), "op6_chat_format": chat.SQL, "op7_pivot_topk": topk.SQL, "op10_decontaminate": decontam.SQL}

"""Registered queries of the package and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import (chat, decontaminate, langid, licences, neighbours, packing, phrases, pieces, simhash, structure,
                           substring, toxicity, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_repair": chat.op1_chat_repair,
    "op2_license_rules": licences.op2_license_rules,
    "op3_simhash_bktree": simhash.op3_simhash_bktree,
    "op4_warc_salvage": warc.op4_warc_salvage,
    "op5_toxicity_fm": toxicity.op5_toxicity_fm,
    "op6_nn_descent": neighbours.op6_nn_descent,
    "op7_qgram_decontam": decontaminate.op7_qgram_decontam,
    "op8_langid_crf": langid.op8_langid_crf,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_substring_dedup": substring.op10_substring_dedup,
    "op11_bin_slack": packing.op11_bin_slack,
    "op12_prefix_free": phrases.op12_prefix_free,
    "op13_glr_repair": structure.op13_glr_repair,
}

ORACLE: dict[str, str] = {
    "op2_license_rules": licences.ORACLE,
    "op4_warc_salvage": warc.ORACLE,
    "op10_substring_dedup": substring.ORACLE,
    "op12_prefix_free": phrases.ORACLE,
    "op13_glr_repair": structure.ORACLE,
}

"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language, lines, mixing, quality_net, quality_rules, secrets, simhash, substrings, toxicity, trie, vectors, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_substrings": substrings.op2_substrings,
        "op3_secrets": secrets.op3_secrets,
        "op4_language": language.op4_language,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_simhash": simhash.op6_simhash,
        "op7_warc": warc.op7_warc,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_quality_net": quality_net.op9_quality_net,
        "op10_mixing": mixing.op10_mixing,
        "op11_prefix_trie": trie.op11_prefix_trie,
        "op12_line_dedup": lines.op12_line_dedup,
        "op13_vector_codes": vectors.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.OP1_SQL,
        "op2_substrings": substrings.OP2_SQL,
        "op7_warc": warc.OP7_SQL,
        "op10_mixing": mixing.OP10_SQL,
        "op11_prefix_trie": trie.OP11_SQL,
        "op12_line_dedup": lines.OP12_SQL,
        "op13_vector_codes": vectors.OP13_SQL,
    }

"""The queries of this subpackage and their DuckDB SQL, added by ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    conversations,
    exact_dedup,
    hard_negatives,
    html_text,
    language,
    minhash,
    mixing,
    packing,
    secrets,
    sharding,
    simhash,
    token_files,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": simhash.query,
        "op2_secrets": secrets.query,
        "op3_html_text": html_text.query,
        "op4_token_files": token_files.query,
        "op5_minhash": minhash.query,
        "op6_warc": warc.query,
        "op7_mixing": mixing.query,
        "op8_exact_dedup": exact_dedup.query,
        "op9_packing": packing.query,
        "op10_language": language.query,
        "op11_hard_negatives": hard_negatives.query,
        "op12_conversations": conversations.query,
        "op13_sharding": sharding.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_exact_dedup": exact_dedup.SQL,
        "op11_hard_negatives": hard_negatives.SQL,
    }

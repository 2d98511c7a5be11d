"""Corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each stage's result as
parquet in the shared folder and hands it, read again, to the next one.

Defined results of every stage: null text counts as empty (the first stage rejects it, as any text without letters);
null doc_ids stand last where ids decide; repeated rows are separate documents until the exact stage, which keeps one
of equal texts; ties are broken by doc_id, then by place; an empty table stays empty; extra columns pass through all
stages but the last, whatever their names; no stage cuts a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aislelens.llm.common import table
from aislelens.llm.exact_dedup import DigestIndex, exact_dedup
from aislelens.llm.language import keep_known
from aislelens.llm.mixing import mix
from aislelens.llm.packing import digest_rows
from aislelens.llm.simhash import near_dedup
from aislelens.session import delete_path, scratch_path, scratch_scope


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or hardly in any learnt language, go."""
    return keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays."""
    with DigestIndex(spark) as index:
        return exact_dedup(docs, index)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, the row with the smallest doc_id stays."""
    return near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources come at their target weights: a row for each time that the mix takes a document."""
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return digest_rows(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixed),
    ("packing", packed),
]

#: Language models, fingerprints and token ids can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what a stage no longer needs is deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

"""The corpus pipeline: five stages over ``documents``, each written and read again.

Null, empty and repeated rows are handled as the operators' docstrings say.  Only the last
stage changes the columns: it returns those of ``documents`` and the place of each copy in
the mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkseek.llm import decontam, linededup, minhash, mixing, quality
from sparkseek.llm.common import Scratch, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands reject go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of alike lines one occurrence stays."""
    return linededup.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the least document stays."""
    return minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with the benchmark go."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by the sources' target weights."""
    return mixing.temperature_mix(docs)


STAGES = [
    ("quality", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
]

#: Compression ratios, SimHash and signatures have no SQL form; tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else scratch.write(out, f"stage-{i}")
    return docs

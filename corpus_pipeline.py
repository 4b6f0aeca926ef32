"""A corpus from raw documents to packed sequences: each stage works on all that the one before kept."""

from __future__ import annotations

from public_tokenizers import path as tokenizer
from pyspark.sql import DataFrame, SparkSession

from granary.llm import linededup, mixing, packing, quality, simhash
from granary.llm.common import remove, scratch, session, table, written_at


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat themselves go."""
    session(spark)
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one."""
    return linededup.deduplicated(docs, n_chars="n_chars").select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: fingerprints within three bits, or five-word shingles alike to 0.8."""
    session(spark)
    return simhash.deduplicated(docs, similar=simhash.SIMILAR)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that tokens meet the margins' weights."""
    return mixing.mixed(docs, details=False)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    session(spark)
    return packing.packed(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_near_dedup),
    ("mixing to target weights", mixing_to_weights),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the fingerprints' hashes nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        # What a stage writes on its way goes when its result is there.
        with scratch(spark) as keep:
            docs, path = written_at(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
            keep.append(path)
        if before:
            remove(spark, before)
        before = path
    return docs

"""The operators applied to the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat, html, linededup, mixing, packing, quality, simhash, simhash_sql, spotsigs, spotsigs_sql, urls, warc
from .common import WORD, session, text_of
from .common import table as read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(session(spark), sf_dir, name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.formatted(rows.unionByName(probe)))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filtered(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "judged.*")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text").withColumn("n_chars", F.length("text").cast("long"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(text_of("text").cast("binary"), 256).alias("kept_sha256"))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spotsigs.followed(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    both = spotsigs.signed(edited, "edited", "edited_signatures")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spotsigs.digest(F.col("signatures")).alias("fingerprint"),
        spotsigs.digest(F.col("edited_signatures")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        spotsigs.likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )


def spotsigs_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.linked(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *(f"quality.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "mix_source", "mix_lang", "topic", "tokens", "weight", "probability", "sampled")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_chat_formatting,
        op2_url_filter,
        op3_best_fit_packing,
        op4_html_extraction,
        op5_line_dedup,
        op6_spotsigs,
        spotsigs_links,
        op7_warc,
        op8_simhash_near_dedup,
        op9_quality_rules,
        op10_mixing,
        pipeline,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": chat.ORACLE,
        "op2_url_filter": urls.ORACLE,
        "op5_line_dedup": linededup.ORACLE,
        "op6_spotsigs": spotsigs_sql.oracle(spotsigs.ANCHORS, spotsigs.CHAIN, spotsigs.STRETCH),
        "spotsigs_links": spotsigs_sql.links_oracle(spotsigs.ANCHORS, spotsigs.CHAIN, spotsigs.STRETCH, spotsigs.THRESHOLD),
        "op7_warc": warc.ORACLE,
        "op8_simhash_near_dedup": simhash_sql.oracle(simhash.SEED, simhash.SHINGLE, simhash.MAX_BITS, WORD),
        "op9_quality_rules": quality.ORACLE,
    }

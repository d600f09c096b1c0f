"""Registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import (
    dart_minhash,
    filter_audit,
    fingerprints,
    language,
    lattice_lm,
    licences,
    main_text,
    merkle,
    quality,
    semantic_leaks,
    sentencepiece_codec,
    sharding,
    suffix_levels,
)
from panelweave.llm.corpus import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan

    return register


def tokenizer_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


@query("op1_hilbert_sharding")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, sf_dir, "documents"), 16)


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode_decode(docs, tokenizer_model())


@query("op3_importance_resampling")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # without the text the settled rows are small
    sampled = quality.importance_sample(docs, table(spark, sf_dir, "labels"), keep_text=False)
    return sampled.select("doc_id", "log_weight", "gumbel_key", "keep")


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language.fit(docs, ~language.held_out())
    labelled = language.predict(docs.select("doc_id", "text"), net)
    return labelled.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query("op5_lattice_lm")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lattice_lm.lattice_scores(docs, ~lattice_lm.held_out(), tokenizer_model())
    held = lattice_lm.held_out().alias("held_out")
    return scored.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op6_dart_minhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_suffix_levels")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the text that is left comes along, not the one that was read, so that a cut can be seen and not only counted
    cut = suffix_levels.cut_repeats(docs, 400, keep_text=True)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text"))


@query("op8_semantic_leaks")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_licences")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs, licences.train(docs))


@query("op10_winnowing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op11_main_text")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


@query("op12_merkle_manifest", merkle.oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


@query("op13_filter_interactions", filter_audit.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

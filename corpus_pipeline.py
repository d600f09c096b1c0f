"""A training-data pipeline over the documents table, from raw texts to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again before the next one begins, so a lost executor costs a part of one stage. A stage that
begins therefore removes the tables that the one before left for its own result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import dart_minhash, quality, semantic_leaks, sentencepiece_codec, suffix_levels
from panelweave.llm.corpus import apart, discard, settled, table
from panelweave.llm.queries import tokenizer_model

REPEATED_BYTES = 200  # 99.5 % of the runs of 51 words of the test tables are longer; a shorter passage is not cut

_left: list[DataFrame] = []


def _sweep() -> None:
    discard(*_left)
    _left.clear()


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject what does not resemble the labelled good documents. Null and empty texts stay, and so
    do repeated rows, each by its own draw."""
    _left.clear()  # of a run that ended early

    def sample(rows: DataFrame) -> DataFrame:
        sampled = quality.importance_sample(rows, table(spark, sf_dir, "labels"))
        _left.append(sampled)
        return sampled.filter("keep").drop("log_weight", "gumbel_key", "keep")

    return apart(docs, [c for c in ("doc_id", "text", "lang") if c in docs.columns], sample)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates. Null texts are near nothing; of repeated rows,
    and of texts without a word that are equal, one stays."""
    _sweep()
    return dart_minhash.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that stand anywhere else; a document of which no word is left goes. Null, empty
    and uncut texts stay as they are."""

    def cut(rows: DataFrame) -> DataFrame:
        cut = suffix_levels.cut_repeats(rows, REPEATED_BYTES, keep_text=True)
        whole = F.col("n_removed") == 0
        left = cut.filter(whole | F.col("kept_text").rlike("[\\p{L}\\p{N}]"))
        new = {"text": F.when(whole, F.col("text")).otherwise(F.col("kept_text")), "n_chars": F.when(whole, F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))}
        return left.withColumns({c: v for c, v in new.items() if c in rows.columns}).drop(*suffix_levels.MADE)

    return apart(docs, [c for c in ("doc_id", "text", "n_chars") if c in docs.columns], cut)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item. Rows are told apart by id and text; null and empty
    texts hold none."""

    def drop(rows: DataFrame) -> DataFrame:
        row = F.xxhash64("doc_id", "text")
        words = settled(semantic_leaks.tokenised(rows.select(row.alias("doc_id"), "text")), "words")
        found = semantic_leaks.leaks(rows, table(spark, sf_dir, "benchmark"), tokens=words)
        leaking = settled(found.select(F.col("doc_id").alias("_row")).distinct(), "leaking")
        discard(words)
        return rows.join(leaking, row == F.col("_row"), "left_anti")

    return apart(docs, ["doc_id", "text"], drop)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the ids and of the text decoded again."""
    return sentencepiece_codec.encode_decode(docs, tokenizer_model(), keep=("ids",)).drop("text")


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_near_copies),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

ORACLE_SQL = None  # hashing, lattices of links and tokenizers are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

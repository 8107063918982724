"""Corpus pipeline: stages over ``documents``, each applied to what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.llm import langid, linededup, minhash, packing, queries, secret_scan
from cellforge.llm.common import fresh, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document whose language is determined with less than this score is rejected.
LEAST_SCORE = 0.1
#: And one whose trigrams are less like those of every learned language: foreign texts and letter junk are below.
LEAST_LIKENESS = -0.15


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or in no language that was learned, go."""
    judged = langid.predict(docs, langid.learned(docs), least=LEAST_LIKENESS)
    return judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("lang_score") >= LEAST_SCORE)).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines of any length that repeat an earlier one, longer ones also if but for an edit, go; so do documents
    of which nothing else was left."""
    total, removed = fresh(docs, "_n_lines", "_n_removed")
    clean = linededup.deduplicate(docs, short=True, added=(total, removed))
    empty = (F.col(removed) > 0) & ~F.col("text").rlike(r"\S")
    return clean.where(~empty).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group of similar documents the one with the smallest id stays."""
    gone = minhash.deduplicate(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["gone_id"], "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every secret found is replaced in the text; no document goes."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left."""
    return packing.pack_documents(docs, queries.tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("secret scan", secrets),
    ("packing", packed),
]

#: SQL expresses neither the classifier nor the tokenizer; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, after=[docs])
    return docs

"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, source mixing, encoding.

All stages take documents as they are: a null text counts as empty, an empty table gives an empty table, and further columns,
whatever their names, come out as they went in. Rows that repeat an identifier are judged by their own texts; rows that repeat both
are one document and share its fate.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import bpe, exact_dedup, lang_id, mixing, simhash
from emberline.llm.common import ensure_checkpoint_dir, table

#: Words that a worker of the last stage remembers: fewer than by itself, as workers still hold memory of the stages before.
REMEMBERED = 300_000
USED = ("doc_id", "text", "lang", "source")


def packed(docs: DataFrame) -> DataFrame:
    """The columns that stages use, and all others within ``_own``, where they meet no result column."""
    return docs.select(*[c for c in docs.columns if c in USED], F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c not in USED]).alias("_own"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*[F.col(c) if c in USED else F.col("_own")[c].alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those without a letter (null texts too), or out of every language's reach, go. Without any labelled document there is no language to be out of reach of, and only those without a letter go."""
    return unpacked(lang_id.identify(packed(docs)).where(~F.col("rejected")), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the row with the largest identifier; rows without an identifier stay only where all rows of a text have none."""
    return unpacked(exact_dedup.exact_dedup(packed(docs), keep="largest").where("kept"), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest identifier stays; rows without an identifier stay only where a whole group has none. Texts without words are one group."""
    digest = F.xxhash64("text")
    found = simhash.similar_documents(docs.select("doc_id", "text", digest.alias("digest")))
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (digest == F.col("_digest")), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; documents without words are never taken."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every row that is left."""
    return bpe.round_trip(docs.select("doc_id", "text"), bpe.default_path(), remembered=REMEMBERED)


STAGES = [("language ID", language_id), ("exact dedup", exact), ("SimHash near-dedup", near), ("source mixing", mixture), ("BPE encoding", encode)]
#: SQL has no BPE and no fitted centroids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and reread."""
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
    return docs

"""Documents to training tokens: quality, line dedup, near-dedup, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of
``documents``.  ``run`` writes each stage's result as Parquet in the shared folder and reads it
back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import bpe, lines, mixing, quality, simhash
from cadenza.llm.common import kept
from cadenza.ship import ship


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that are boilerplate in their host.

    A null text fails the base rules; an empty table stays empty; repeated rows are judged alike;
    further columns stay."""
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return quality.judged(docs).where("kept").select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a document with a smaller doc_id has.

    A null text becomes an empty one; a null doc_id comes after all others; rows that share a doc_id
    are one document; an empty table stays empty."""
    done = lines.dedup_lines(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return done.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id, null after all others.

    Texts are linked by op4's fingerprints and by the verified similarity of their shingles.

    Different texts under one doc_id, or without one, are judged each as its own; an empty table
    stays empty."""
    ship(spark)
    return simhash.near_duplicates(docs, by_fingerprint=True)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in rows of their own.

    A null source is a source; rows that repeat a doc_id are taken or left together; an empty table
    stays empty."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; a null text has none, an empty table gives no rows."""
    import public_tokenizers

    return bpe.tokens(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", good_quality),
    ("line_dedup", fresh_lines),
    ("near_dedup", no_near_duplicates),
    ("mixing", source_mix),
    ("bpe", tokens),
]

#: SQL has no byte-pair merges or fingerprint links; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

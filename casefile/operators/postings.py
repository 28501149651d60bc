"""A stored search index: vectors, texts and token postings of chunks.

A chunk's posting holds its distinct tokens (runs of digits and Latin or Greek letters of its normalized text), once each.
Query tokens are made of the same characters, so a query token occurs in a chunk's text exactly if it is part of one of
the chunk's tokens: keyword hits join the pool with postings, and no text of a chunk is read or normalized by a search."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textnorm
from ..sources.readers import shared_folder


@dataclass(frozen=True)
class Index:
    """``vectors (decision_id, idx, vec)``, ``texts (decision_id, idx, text)`` and ``postings (decision_id, idx, tokens)``."""

    vectors: DataFrame
    texts: DataFrame
    postings: DataFrame | None = None


def build_index(chunks: DataFrame, folder: str) -> Index:
    """Writes the tables of ``chunks (decision_id, idx, text, vec)`` under ``folder``; chunks are computed, and normalized, once."""
    spark = chunks.sparkSession
    chunks.select("decision_id", "idx", "text", "vec").write.parquet(f"{folder}/chunks")
    texts = spark.read.parquet(f"{folder}/chunks").select("decision_id", "idx", "text")
    tokens = F.array_join(textnorm.search_tokens(F.coalesce("text", F.lit(""))), " ")
    texts.select("decision_id", "idx", tokens.alias("tokens")).write.parquet(f"{folder}/postings")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> Index:
    """The index stored under ``folder``."""
    chunks = spark.read.parquet(f"{folder}/chunks")
    return Index(chunks.select("decision_id", "idx", "vec"), chunks.select("decision_id", "idx", "text"), spark.read.parquet(f"{folder}/postings"))


def as_index(chunks: DataFrame | Index, vectors_only: bool = False) -> Index:
    """An index as it is; of a plain chunk table one that is built in the shared folder, or its columns alone."""
    if isinstance(chunks, Index):
        return chunks
    if vectors_only:
        return Index(chunks.select("decision_id", "idx", "vec"), chunks)
    return build_index(chunks, f"{shared_folder(chunks.sparkSession)}/index-{uuid.uuid4().hex}")


def token_hits(pool: DataFrame, asked: DataFrame, index: Index) -> DataFrame:
    """``pool (query_id, decision_id, idx, ...)`` with ``hits``: how many of the query's tokens occur in the chunk's text.

    ``asked``: ``(query_id, tokens)``. Hits are counted where a posting meets the pool's row; only their number goes further."""
    held = pool.join(index.postings.withColumnRenamed("tokens", "_held"), ["decision_id", "idx"]).join(asked.select("query_id", F.col("tokens").alias("_asked")), "query_id")
    return held.withColumn("hits", F.size(F.filter("_asked", lambda t: F.contains(F.col("_held"), t)))).drop("_held", "_asked")

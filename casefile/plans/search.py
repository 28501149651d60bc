"""Batch hybrid search: a table of queries against the chunk table, or against a stored index of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.textnorm import decision_title, snippet
from ..operators.postings import Index, as_index
from ..operators.ranking import best_per_decision, rank_chunks


def _hits(queries: DataFrame, chunks: DataFrame | Index, decisions: DataFrame, k: int, pool: int) -> DataFrame:
    asked = queries.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    index = as_index(chunks)
    best = best_per_decision(rank_chunks(asked, index, decisions, pool), k)
    # Texts are read for the winners alone.
    rows = best.join(index.texts.select("decision_id", "idx", "text"), ["decision_id", "idx"]).join(decisions.select(F.col("id").alias("decision_id"), "number", "year", "dtype", "pdf_url"), "decision_id")
    return rows.join(asked.select("query_id", F.col("text").alias("query")), "query_id")


def search(queries: DataFrame, chunks: DataFrame | Index, decisions: DataFrame, k: int = 8, pool: int = 60) -> DataFrame:
    """The k best decisions per query with score, snippet and title. Blank queries are left out."""
    rows = _hits(queries, chunks, decisions, k, max(pool, 25 * k))
    return rows.select("query_id", "query", "rank", "decision_id", "number", "year", F.col("dtype").alias("type"), "pdf_url", F.round("score", 4).alias("score"), snippet(F.col("text")).alias("snippet"), decision_title(F.col("number"), F.col("year"), F.col("dtype")).alias("title"))


def top_chunks(queries: DataFrame, chunks: DataFrame | Index, decisions: DataFrame, k: int = 10) -> DataFrame:
    """The same ranking with the chunks' whole text and the score as it is, for grounded prompts."""
    rows = _hits(queries, chunks, decisions, k, max(200, 25 * k))
    return rows.select("query_id", "query", "rank", "decision_id", "number", "year", F.col("dtype").alias("type"), "pdf_url", "score", "text", decision_title(F.col("number"), F.col("year"), F.col("dtype")).alias("title"))

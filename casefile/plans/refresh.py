"""The corpus job: pending decisions with fetched pages become chunks with vectors; tables are published by one manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_pages, drop_short_chunks, number_chunks
from ..operators.embedding import embed_column, feature_hashing
from ..operators.tables import apply_outcomes, classify_documents, pending, replace_chunks, upsert_decisions
from . import store
from .store import publish  # noqa: F401


def build_chunks(pages: DataFrame, make_embedder: Callable = feature_hashing) -> DataFrame:
    """Numbered chunks of ``pages (decision_id, page, text)`` with their vectors."""
    rows = number_chunks(drop_short_chunks(chunk_pages(pages)))
    return embed_column(rows, "text", make_embedder).select("decision_id", "idx", "page", "text", "vec")


def process(decisions: DataFrame, pages: DataFrame, make_embedder: Callable = feature_hashing, min_year: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(outcomes, chunks, ids)`` of the pending decisions: what became of each, their new chunks, and whose chunks those replace."""
    todo = pending(decisions, min_year=min_year).select(F.col("id").alias("decision_id"))
    work = pages.join(todo, "decision_id", "left_semi")
    made = build_chunks(work, make_embedder).persist()  # counted for the outcomes, then written
    done = classify_documents(work, made).withColumnRenamed("decision_id", "id")
    failed = todo.select(F.col("decision_id").alias("id")).join(done, "id", "left_anti").select("id", F.lit("error").alias("status"), F.lit(None).cast("long").alias("text_chars"), F.lit(None).cast("long").alias("n_chunks"))
    return done.unionByName(failed), made, done.select(F.col("id").alias("decision_id"))


def refresh(decisions: DataFrame, chunks: DataFrame, pages: DataFrame, make_embedder: Callable = feature_hashing, min_year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Decision and chunk tables after one run. Pending decisions without pages fail and keep their older chunks."""
    outcomes, made, ids = process(decisions, pages, make_embedder, min_year)
    return apply_outcomes(decisions, outcomes), replace_chunks(chunks, made, ids)


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The published table. Deltas hold feed rows with their ``arrival``, which are upserted on reading."""
    base, delta = store.parts(spark, root, name)
    return base if delta is None else upsert_decisions(base, delta, "arrival")


def refresh_tables(spark: SparkSession, root: str, pages: DataFrame, make_embedder: Callable = feature_hashing, min_year: int | None = None) -> int:
    """``refresh`` on the published tables: one commit publishes both. Of the chunks only buckets of decisions that were
    processed are written; a chunk table that was published whole is bucketed by the first run."""
    tables = store.manifest(spark, root)["tables"]
    if "key" not in tables["chunks"]:
        tables["chunks"] = store.bucketed(current(spark, root, "chunks"), root, "chunks", "decision_id")
    decisions = current(spark, root, "decisions")
    outcomes, made, ids = process(decisions, pages, make_embedder, min_year)
    chunks = store.replace_in_buckets(spark, root, "chunks", tables["chunks"], made, ids)
    version = store.commit(spark, root, {"chunks": chunks, "decisions": store.write_base(apply_outcomes(decisions, outcomes), root, "decisions")})
    made.unpersist()
    return version

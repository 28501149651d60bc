"""Upserts, selection of work, outcomes and counts of the decision table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import leading_int

#: Columns that a feed row may change.
FEED_COLUMNS = ("number", "year", "dtype", "pdf_url", "source_date", "raw_json", "scraped_at")


def upsert_decisions(current: DataFrame, incoming: DataFrame, arrival: str | None = None) -> DataFrame:
    """``current`` with the incoming rows inserted or updated by id; the row of the highest ``arrival`` wins.

    Without ``arrival`` ids are expected once. Status, counts and times of ingestion of known rows stay."""
    if arrival:
        last = Window.partitionBy("id").orderBy(F.desc(arrival))
        incoming = incoming.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    new = incoming.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in FEED_COLUMNS])
    both = current.join(new, F.col("id") == F.col("_id"), "full_outer")
    hit, fresh = F.col("_id").isNotNull(), F.col("id").isNull()
    filled = {"id": F.coalesce("id", "_id"), "status": F.when(fresh, F.lit("new")).otherwise(F.col("status"))}
    filled |= {c: F.when(fresh, F.lit(0)).otherwise(F.col(c)).cast(current.schema[c].dataType) for c in ("text_chars", "n_chunks")}
    filled |= {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in FEED_COLUMNS}
    return both.select(*[filled.get(c, F.col(c)).alias(c) for c in current.columns])


def pending(decisions: DataFrame, year: str | None = None, min_year: int | None = None) -> DataFrame:
    """Decisions still to be done, in no order; options that are empty or 0 are off."""
    rows = decisions.where(F.col("status").isin("new", "error"))
    if year:
        rows = rows.where(F.col("year") == str(year))
    if min_year:
        rows = rows.where(leading_int(F.col("year")) >= int(min_year))
    return rows


def select_pending(decisions: DataFrame, year: str | None = None, min_year: int | None = None, limit: int | None = None) -> DataFrame:
    """Decisions still to be done, newest year and highest number first; options that are empty or 0 are off."""
    rows = pending(decisions, year, min_year)
    rows = rows.orderBy(leading_int(F.col("year")).desc(), leading_int(F.col("number")).desc(), "id")
    return rows.limit(limit) if limit else rows


def recent_min_year(now: dt.datetime | None = None) -> int:
    """The year before the current one, UTC."""
    return (now or dt.datetime.now(dt.timezone.utc)).year - 1


def classify_documents(pages: DataFrame, chunks: DataFrame, least_chars: int = 200) -> DataFrame:
    """``(decision_id, status, text_chars, n_chunks)``; a document with little text has no text and no chunks counted."""
    chars = pages.groupBy("decision_id").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("text_chars"))
    made = chunks.groupBy("decision_id").agg(F.count("*").alias("n"))
    enough = F.col("text_chars") >= least_chars
    return chars.join(made, "decision_id", "left").select("decision_id", F.when(enough, "embedded").otherwise("no_text").alias("status"), "text_chars", F.when(enough, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_chunks"))


def apply_outcomes(decisions: DataFrame, outcomes: DataFrame, now: Column | None = None) -> DataFrame:
    """Decisions with the outcomes ``(id, status, text_chars, n_chunks)`` set; an error sets the status only."""
    o = outcomes.select(F.col("id").alias("_id"), F.col("status").alias("_status"), F.col("text_chars").alias("_text_chars"), F.col("n_chunks").alias("_n_chunks"))
    both = decisions.join(o, F.col("id") == F.col("_id"), "left")
    done = F.col("_status").isNotNull() & (F.col("_status") != "error")
    filled = {"status": F.coalesce("_status", "status"), "ingested_at": F.when(done, F.current_timestamp() if now is None else now).otherwise(F.col("ingested_at"))}
    filled |= {c: F.when(done, F.col(f"_{c}").cast(decisions.schema[c].dataType)).otherwise(F.col(c)) for c in ("text_chars", "n_chunks")}
    return both.select(*[filled.get(c, F.col(c)).alias(c) for c in decisions.columns])


def remaining_work(decisions: DataFrame) -> DataFrame:
    """Decisions that are neither embedded nor without text."""
    finished = decisions.where(F.col("status").isin("embedded", "no_text")).select("id")
    return decisions.join(finished, "id", "left_anti")


def corpus_stats(decisions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Decisions and their chunks in all (status null) and by status."""
    made = chunks.groupBy("decision_id").agg(F.count("*").alias("n"))
    each = decisions.join(made, decisions["id"] == made["decision_id"], "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return each.rollup("status").agg(F.count("*").alias("n_decisions"), F.sum("n").alias("n_chunks"))


def replace_chunks(existing: DataFrame, new: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunk table with the chunks of the decisions in ``ids`` replaced by ``new``."""
    return existing.join(ids, "decision_id", "left_anti").unionByName(new)

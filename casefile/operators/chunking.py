"""Pages to overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.textnorm import collapse_whitespace


def chunk_text(c: Column, size: int = 1400, overlap: int = 200) -> Column:
    """Array of windows of ``size`` characters that overlap; the last reaches the end. Empty text: none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step, n = size - overlap, F.length(c)
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(step)).cast("int"))
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(c, i * step + 1, F.lit(size)))
    return F.when(n > 0, windows).otherwise(F.array().cast("array<string>"))


def chunk_pages(pages: DataFrame, size: int = 1400, overlap: int = 200) -> DataFrame:
    """``(decision_id, page, pos, text)`` of every page's collapsed text."""
    flat = pages.select("decision_id", "page", collapse_whitespace(F.coalesce("text", F.lit(""))).alias("flat"))
    return flat.select("decision_id", "page", F.posexplode(chunk_text(F.col("flat"), size, overlap)).alias("pos", "text"))


def drop_short_chunks(chunks: DataFrame, least: int = 40) -> DataFrame:
    return chunks.where(F.length(F.trim("text")) >= least)


def number_chunks(chunks: DataFrame) -> DataFrame:
    """``idx`` from 0 within each decision, by page and place in it."""
    w = Window.partitionBy("decision_id").orderBy("page", "pos")
    return chunks.withColumn("idx", F.row_number().over(w) - 1).drop("pos")

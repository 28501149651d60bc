"""Feed rows to decision rows, and checks on file names and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers


def pick_dtype(cells: Column) -> Column:
    """The first trimmed cell in capitals that holds a Greek capital; empty if there is none."""
    trimmed = F.transform(cells, lambda c: F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    capitals = F.filter(trimmed, lambda c: c.rlike(r"[Α-Ω]") & c.rlike(r"\p{IsUppercase}") & ~c.rlike(r"[\p{IsLowercase}\p{Lt}]"))
    return F.coalesce(F.get(capitals, F.lit(0)), F.lit(""))


def _parsed(feed: DataFrame) -> DataFrame:
    cells = F.transform("cells", lambda c: F.coalesce(c, F.lit("")))
    rows = feed.withColumn("cells", cells)
    url = F.nullif(F.regexp_extract(F.array_join("cells", " "), r"(?i)href='([^']*\.pdf[^']*)'", 1), F.lit(""))
    return rows.withColumn("pdf_url", url)


def parse_feed_rows(feed: DataFrame, *keep: str) -> DataFrame:
    """Decision rows of the feed rows that link a document; null cells count as empty. Columns to ``keep`` come last."""
    rows = _parsed(feed).where("pdf_url is not null")
    named = numbers.number_year_from_url(F.col("pdf_url"))
    cell = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    return rows.select(cell(0).alias("id"), named["number"].alias("number"), named["year"].alias("year"), pick_dtype(F.col("cells")).alias("dtype"), "pdf_url", cell(2).alias("source_date"), F.to_json("cells").alias("raw_json"), F.date_trunc("second", F.current_timestamp()).alias("scraped_at"), *keep)


def feed_tallies(feed: DataFrame) -> DataFrame:
    """One row: rows with a document, rows without, and the announced total."""
    return _parsed(feed).agg(F.count_if(F.col("pdf_url").isNotNull()).alias("saved"), F.count_if(F.col("pdf_url").isNull()).alias("skipped"), F.max("recordsTotal").alias("announced"))


def number_shape_profile(decisions: DataFrame) -> DataFrame:
    """Decisions per written prefix of the number in the file name; ``unparseable`` for other names."""
    return decisions.groupBy(F.coalesce(numbers.raw_prefix(F.col("pdf_url")), F.lit("unparseable")).alias("shape")).agg(F.count("*").alias("n"))


def resolve_fetches(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Per decision the first candidate URL that was fetched, else the error of the last that failed.

    ``candidates``: (id, urls); ``log``: (url, ok, error)."""
    each = candidates.select("id", F.posexplode("urls").alias("pos", "url")).join(log, "url", "left")
    ok = F.coalesce(F.col("ok"), F.lit(False))
    out = each.groupBy("id").agg(F.min_by("url", F.when(ok, F.col("pos"))).alias("url"), F.max_by("error", F.when(~ok & F.col("ok").isNotNull(), F.col("pos"))).alias("error"))
    return out.select("id", "url", F.when(F.col("url").isNull(), F.col("error")).alias("error"))


def file_name_collisions(decisions: DataFrame) -> DataFrame:
    """Decisions that share a file name with another one."""
    named = decisions.withColumn("file_name", numbers.file_name(F.col("pdf_url")))
    often = named.groupBy("file_name").agg(F.count_distinct("id").alias("n")).where("n > 1")
    return named.join(often, "file_name", "left_semi")


def repair_numbers(decisions: DataFrame) -> DataFrame:
    """Numbers and years read from the file name again; ``changed`` marks rows where a readable name says otherwise."""
    got = numbers.number_year_from_url(F.col("pdf_url"))
    differs = lambda c: got[c] != F.coalesce(F.col(c), F.lit(""))
    changed = (got["number"] != "") & (differs("number") | differs("year"))
    return decisions.withColumns({"changed": changed, "number": F.when(changed, got["number"]).otherwise(F.col("number")), "year": F.when(changed, got["year"]).otherwise(F.col("year"))})

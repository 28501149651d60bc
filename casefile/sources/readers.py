"""Reading feeds, tables and documents, and writing results."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets
    a new one, and a cluster an error: its machines share no temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder or current.isDefined():
        return folder or current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(recordsTotal, cells)`` of landed feed pages; a page without rows gives none."""
    pages = spark.read.schema(schemas.FEED).option("multiLine", True).json(path)
    return pages.select("recordsTotal", F.explode("data").alias("cells"))


def read_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The decision and chunk tables of a folder."""
    return tuple(spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in (("decisions", schemas.DECISIONS), ("chunks", schemas.CHUNKS)))


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """``(file_name, content)`` of the files whose name matches."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select(F.substring_index("path", "/", -1).alias("file_name"), "content")


def form_feed_pages(content: bytes) -> Iterator[str]:
    """The default extractor: UTF-8 text whose pages end with a form feed."""
    yield from content.decode("utf-8", "replace").split("\f")


def extract_pages(documents: DataFrame, extractor: Callable[[bytes], Iterator] = form_feed_pages, key: str = "decision_id") -> DataFrame:
    """``(key, page, text)``, pages from 1. A page is a text or a function that gives it; one that fails gives
    an empty text, and a document that fails altogether one empty page."""

    def run(batches):
        for batch in batches:
            rows = []
            for k, content in zip(batch[key], batch["content"], strict=True):
                try:
                    pages = list(extractor(content))
                except Exception:
                    pages = [""]
                for n, page in enumerate(pages, 1):
                    try:
                        rows.append((k, n, page() if callable(page) else page))
                    except Exception:
                        rows.append((k, n, ""))
            yield pd.DataFrame(rows, columns=[key, "page", "text"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, "content").mapInPandas(run, f"{key} {kind}, page int, text string")


def results_json(results: DataFrame) -> DataFrame:
    """``(query, results)`` per query: its hits by rank."""
    hit = F.struct("rank", "number", "year", "type", "pdf_url", "score", "snippet", "title")
    return results.groupBy("query").agg(F.array_sort(F.collect_list(hit)).alias("hits")).select("query", F.transform("hits", lambda h: h.dropFields("rank")).alias("results"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """``(query, results)`` of files that ``write_results`` wrote."""
    hit = "number string, year string, type string, pdf_url string, score double, snippet string, title string"
    return spark.read.schema(f"query string, results array<struct<{hit.replace(' ', ':').replace(',:', ',')}>>").json(path)


def write_results(results: DataFrame, path: str) -> None:
    """One JSON object per query; non-ASCII text is written as it is."""
    results_json(results).write.mode("overwrite").json(path)

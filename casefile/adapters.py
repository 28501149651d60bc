"""The given tables in the shapes of this library, by fixed arithmetic on their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.numbers import number_year_from_url
from .operators.chunking import chunk_pages, drop_short_chunks, number_chunks

PRIMARY, OLD = "https://www.primary.example.org/files/", "http://www.old.example.net/pdf/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, m = table(spark, sf_dir, "documents"), F.col("doc_id") % 20
    prefix = F.when(m <= 13, "").when(m <= 16, "A").when(m == 17, "E").when(m == 18, "AA").otherwise("Α")
    named = F.concat(F.lit("Apofasi-"), prefix, (F.col("doc_id") % 1500 + 1).cast("string"), F.lit("-"), (2016 + F.col("doc_id") % 10).cast("string"), F.lit(".pdf"))
    name = F.when(F.col("doc_id") % 97 == 0, F.concat(F.lit("scan-"), F.col("doc_id").cast("string"), F.lit(".pdf"))).otherwise(named)
    url = F.concat(F.when(F.col("doc_id") % 3 == 0, PRIMARY).otherwise(OLD), name)
    rows = d.select("doc_id", "lang", "n_chars", url.alias("pdf_url"))
    got = number_year_from_url(F.col("pdf_url"))
    dtype = F.when(F.col("lang") == "fr", "ΟΡΙΣΤΙΚΗ").when(F.col("lang") == "de", "ΠΡΟΣΩΡΙΝΗ").when(F.col("lang") == "es", "ΑΝΑΣΤΟΛΗ").otherwise("")
    status = F.element_at(F.array(*map(F.lit, ("new", "no_text", "embedded", "error"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return rows.select(F.col("doc_id").cast("string").alias("id"), got["number"].alias("number"), got["year"].alias("year"), dtype.alias("dtype"), "pdf_url", F.lit("").alias("source_date"), F.lit("[]").alias("raw_json"), status.alias("status"), F.col("n_chars").cast("int").alias("text_chars"), (F.col("doc_id") % 7).alias("n_chunks"), F.timestamp_seconds(F.lit(1_704_067_200)).alias("scraped_at"), F.lit(None).cast("timestamp").alias("ingested_at"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("decision_id"), F.lit(1).alias("page"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's numbered chunks, with vectors of the embeddings dealt to them."""
    e = table(spark, sf_dir, "embeddings")
    made = number_chunks(drop_short_chunks(chunk_pages(pages(spark, sf_dir))))
    made = made.withColumn("vec_id", (F.col("decision_id").cast("long") * 7 + F.col("idx")) % F.lit(e.count()))
    return made.join(e.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("decision_id", "idx", "page", "text", "vec")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    b = table(spark, sf_dir, "benchmark").withColumn("vec_id", F.col("item_id") * 7 % F.lit(n)).withColumn("wanted", (F.col("item_id") * 3).cast("string"))
    rows = b.join(e.select("vec_id", F.col("embedding").alias("vec")), "vec_id", "left").join(decisions(spark, sf_dir).select(F.col("id").alias("wanted"), "number", "year"), "wanted", "left")
    ref = F.when((F.col("item_id") % 4 == 0) & F.col("number").isNotNull(), F.concat(F.lit(" "), F.col("number"), F.lit("/"), F.col("year"))).otherwise(F.lit(""))
    return rows.select(F.col("item_id").alias("query_id"), F.concat("text", ref).alias("text"), "vec")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    owner = F.when(F.col("conv_id") % 5 != 0, F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string")))
    at = lambda turn: F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 60 + turn)
    return c.select(F.col("conv_id").alias("id"), F.concat(F.lit("chat "), F.col("conv_id").cast("string")).alias("title"), owner.alias("owner"), at(F.lit(0)).alias("created_at"), at(F.col("last")).alias("updated_at"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    sources = F.when(F.col("role") == "assistant", F.when(F.col("turn") % 2 == 0, F.lit("broken [")).otherwise(F.concat(F.lit('[{"number": "'), F.col("conv_id").cast("string"), F.lit('", "year": "2024"}]'))))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("chat_id"), "role", F.col("text").alias("content"), sources.alias("sources"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 60 + F.col("turn")).alias("created_at"))


def token_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("turn_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("token"), F.when(F.col("event_type") == "purchase", F.col("props")).alias("sources"))


def answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token events, and one event per turn that says it is done."""
    tokens = token_events(spark, sf_dir).withColumn("done", F.lit(False))
    ends = tokens.groupBy("turn_id").agg((F.max("seq") + 1).alias("seq"), F.max("ts").alias("ts"))
    return tokens.unionByName(ends.withColumns({"token": F.lit(None).cast("string"), "sources": F.lit(None).cast("string"), "done": F.lit(True)}))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("text"))

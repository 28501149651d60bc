"""Token streams: lines to tokens, tokens to turns, keystrokes to queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Schemas of the dialects' JSON objects.
_OPENAI = "choices array<struct<delta:struct<content:string>>>"
_GEMINI = "candidates array<struct<content:struct<parts:array<struct<text:string>>>>>"
_NDJSON = "message struct<content:string>, done boolean"


def parse_token_lines(lines: DataFrame, dialect: str) -> DataFrame:
    """``(turn_id, seq, ts, token)`` of stream lines; lines that don't parse, and empty tokens, are left out.

    ``openai`` and ``gemini`` read server-sent ``data:`` lines, ``ndjson`` one object per line up to the first done."""
    if dialect == "ndjson":
        rows = lines.withColumn("_j", F.from_json("line", _NDJSON))
        done = F.min(F.when(F.col("_j.done"), F.col("seq"))).over(Window.partitionBy("turn_id"))
        rows = rows.withColumn("_end", done).where("_end is null or seq <= _end").withColumn("token", F.col("_j.message.content"))
    elif dialect in ("openai", "gemini"):
        body = F.trim(F.substring("line", 6, 1 << 30))
        rows = lines.where(F.col("line").startswith("data:")).withColumn("_b", body).where("_b not in ('', '[DONE]')")
        if dialect == "openai":
            rows = rows.withColumn("token", F.get(F.from_json("_b", _OPENAI)["choices"], F.lit(0))["delta"]["content"])
        else:
            parts = F.get(F.from_json("_b", _GEMINI)["candidates"], F.lit(0))["content"]["parts"]
            rows = rows.withColumn("token", F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""))
    else:
        raise ValueError(f"no dialect {dialect!r}")
    return rows.where("token is not null and token != ''").select("turn_id", "seq", "ts", "token")


def assemble_turns(events: DataFrame, span: int = 4_096) -> DataFrame:
    """``(turn_id, text, sources)`` of ``events (turn_id, seq, token, sources)``; turns without text are left out.

    Tokens are put together twice: those of ``span`` numbers each first, then these pieces, so that no row holds
    a long turn token by token. The last sources that are not empty win."""
    told = ~F.coalesce("sources", F.lit("")).isin("", "[]")
    tokens = F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("seq", "token"))))
    piece = F.array_join(F.transform(tokens, lambda t: t["token"]), "")
    pieces = events.withColumn("_span", F.floor(F.col("seq") / span)).groupBy("turn_id", "_span").agg(piece.alias("piece"), F.max(F.when(told, F.struct("seq", "sources"))).alias("last"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_span", "piece"))), lambda p: p["piece"]), "")
    turns = pieces.groupBy("turn_id").agg(text.alias("text"), F.max("last").alias("last"))
    return turns.where("text != ''").select("turn_id", "text", "last.sources")


def debounce_queries(events: DataFrame, gap: str = "350 milliseconds", least: int = 2) -> DataFrame:
    """``(user_id, settled_at, text)``: the last text of every run of keystrokes without a pause of ``gap``, trimmed.

    Works on batches and, behind a watermark on ``ts``, on streams."""
    last = F.max_by("text", F.struct("ts", "seq"))
    runs = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.trim(last).alias("text"), F.max("ts").alias("settled_at"))
    return runs.where(F.length("text") >= least).select("user_id", "settled_at", "text")

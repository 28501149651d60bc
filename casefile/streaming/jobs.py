"""Streaming jobs: feed upserts, refreshes, turns and settled queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas
from ..operators.events import debounce_queries
from ..operators.feed import parse_feed_rows
from ..plans import store
from ..plans.refresh import refresh_tables


def stream_feed_upsert(spark: SparkSession, landing: str, root: str, checkpoint: str, keep_seconds: float = 86_400.0) -> StreamingQuery:
    """Upserts every landed feed page into the published decision table; pages that come again change nothing. Of rows
    of one id the last wins: that of the newest file (of equally new ones, of the last by name), then the last in it.

    A micro-batch writes its parsed rows as a delta, which readers merge: neither the table nor what it has is read or written.
    The manifest keeps the number of the last batch, so that one that is run again adds nothing; versions replaced for ``keep_seconds`` go."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        now = store.manifest(spark, root)
        if now["batches"].get(checkpoint, -1) >= batch_id:
            return
        rows = batch.select("recordsTotal", "file", F.posexplode("data").alias("pos", "cells"))
        rows = rows.withColumn("arrival", F.struct(F.lit(now["version"]).cast("long").alias("version"), "file", "pos"))
        parsed = parse_feed_rows(rows, "arrival")
        last = parsed.groupBy("id").agg(F.max_by(F.struct(*parsed.columns), "arrival").alias("row")).select("row.*")
        entry = store.write_delta(last, root, "decisions", now["tables"]["decisions"], F.col("arrival"))
        store.commit(spark, root, {"decisions": entry}, {checkpoint: batch_id})
        if batch_id % store.FOLD == 0:
            store.vacuum(spark, root, keep_seconds)

    pages = spark.readStream.schema(schemas.FEED).option("multiLine", True).json(landing)
    pages = pages.select("recordsTotal", "data", F.struct("_metadata.file_modification_time", "_metadata.file_path").alias("file"))
    return pages.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_refresh(spark: SparkSession, landing: str, root: str, checkpoint: str, pages: DataFrame, min_year: int | None = None, keep_seconds: float = 86_400.0) -> None:
    """One daily run: new metadata, then all pending work, both tables published by one commit; older versions go after ``keep_seconds``."""
    stream_feed_upsert(spark, landing, root, checkpoint, keep_seconds).awaitTermination()
    refresh_tables(spark, root, pages, min_year=min_year)
    store.vacuum(spark, root, keep_seconds)


_TURN = "turn_id {0}, text string, sources string"
_OPEN = "seqs array<long>, tokens array<string>, sources string, sources_seq long, last long, closed boolean"


def stream_assemble_turns(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``assemble_turns`` on a stream of tokens (append mode), with a state of its own per open turn.

    A turn comes out at its event with ``done`` (if the events have such a column), which a finished or failed answer sends last, or when it has had
    no event for ``late``: turns broken off in the middle come out as far as they went. Tokens are put in order of ``seq``
    when the turn closes; those that come after a ``done`` are left out. A closed turn is remembered for ``late``, so that its stragglers open no new one."""
    wait = events.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + interval '{late}')").first()[0]
    done = F.col("done") if "done" in events.columns else F.lit(False)
    kind = events.schema["turn_id"].dataType.simpleString()

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, tokens, sources, sources_seq, last, closed = state.get if state.exists else ([], [], None, -1, 0, False)
        if state.hasTimedOut:
            state.remove()
            ends = not closed
        else:
            ends, seqs, tokens = False, list(seqs), list(tokens)
            for part in parts:
                last = max(last, *(int(t.timestamp() * 1000) for t in part["ts"]))
                for seq, token, source, end in zip(part["seq"].tolist(), part["token"], part["sources"], part["done"], strict=True):
                    if token:
                        seqs.append(seq)
                        tokens.append(token)
                    if source and source != "[]" and seq > sources_seq:
                        sources, sources_seq = source, seq
                    ends = ends or bool(end)
            ends = ends and not closed
            keep = ([], [], None, -1) if ends or closed else (seqs, tokens, sources, sources_seq)
            state.update((*keep, last, ends or closed))
            state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))
        if ends and tokens:
            text = "".join(t for _, t in sorted(zip(seqs, tokens, strict=True)))
            yield pd.DataFrame({"turn_id": [key[0]], "text": [text], "sources": [sources]})

    rows = events.select("turn_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "token", "sources", done.alias("done")).withWatermark("ts", late)
    return rows.groupBy("turn_id").applyInPandasWithState(run, _TURN.format(kind), _OPEN, "append", GroupStateTimeout.EventTimeTimeout)


def stream_debounce(keystrokes: DataFrame, gap: str = "350 milliseconds", late: str = "10 seconds") -> DataFrame:
    """``debounce_queries`` on a stream of keystrokes (append mode)."""
    return debounce_queries(keystrokes.withWatermark("ts", late), gap)

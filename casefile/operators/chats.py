"""Chat tables with owners. Without an owner a chat is visible to nobody; ``shared`` shows all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def with_owner(chats: DataFrame) -> DataFrame:
    """Old rows without an owner column become rows without an owner."""
    return chats.sparkSession.createDataFrame([], schemas.CHATS).unionByName(chats, allowMissingColumns=True)


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("chat_id").agg(F.count("*").alias("n_messages"))


def list_chats(chats: DataFrame, messages: DataFrame, owners: DataFrame, shared: bool = False) -> DataFrame:
    """Per owner of ``owners``: chats, newest first, with their number of messages. Where chats are shared all owners see
    the same: one listing, with no viewer."""
    asked = owners.where(F.coalesce("owner", F.lit("")) != "").select(F.col("owner").alias("viewer")).distinct()
    seen = chats.withColumn("viewer", F.lit(None).cast("string")) if shared else chats.join(asked, chats["owner"] == asked["viewer"])
    n = message_counts(messages)
    rows = seen.join(n, seen["id"] == n["chat_id"], "left")
    return rows.select("viewer", "id", "title", "updated_at", F.coalesce("n_messages", F.lit(0)).alias("n_messages")).orderBy("viewer", F.desc("updated_at"), F.desc("id"))


def owned(requests: DataFrame, chats: DataFrame, shared: bool = False) -> DataFrame:
    """Requests ``(chat_id, owner, ...)`` whose chat exists and belongs to a non-empty owner who asks."""
    mine = chats.select(F.col("id").alias("_id"), F.col("owner").alias("_owner"))
    on = F.col("chat_id") == F.col("_id")
    if not shared:
        on = on & (F.col("owner") == F.col("_owner")) & (F.col("owner") != "")
    return requests.join(mine, on, "left_semi")


def chat_transcript(messages: DataFrame, requests: DataFrame, chats: DataFrame, shared: bool = False) -> DataFrame:
    """``(chat_id, id, role, content, sources)`` of the owned chats asked for; unreadable sources are empty, absent null."""
    asked = owned(requests, chats, shared).select("chat_id").distinct()
    parsed = F.when(F.coalesce("sources", F.lit("")) != "", F.coalesce(F.from_json("sources", T.ArrayType(schemas.SOURCE), {"mode": "PERMISSIVE"}), F.array().cast(T.ArrayType(schemas.SOURCE))))
    return messages.join(asked, "chat_id", "left_semi").select("chat_id", "id", "role", "content", parsed.alias("sources")).orderBy("chat_id", "id")


def append_messages(chats: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chats with the time of their latest new message, and messages with the new ones."""
    last = new.groupBy(F.col("chat_id").alias("_id")).agg(F.max("created_at").alias("_at"))
    moved = chats.join(last, F.col("id") == F.col("_id"), "left").select(*[F.coalesce("_at", "updated_at").alias(c) if c == "updated_at" else F.col(c) for c in chats.columns])
    return moved, messages.unionByName(new, allowMissingColumns=True)


def chat_titles(messages: DataFrame, chars: int = 60, most: int = 80) -> DataFrame:
    """``(chat_id, title)``: the beginning of the first question."""
    return messages.where("role = 'user'").groupBy("chat_id").agg(F.substring(F.min_by(F.coalesce("content", F.lit("")), F.col("id")), 1, min(chars, most)).alias("title"))


def delete_chats(chats: DataFrame, messages: DataFrame, requests: DataFrame, shared: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chats and messages without the owned chats asked for, and ``requests`` with ``ok``."""
    gone = owned(requests, chats, shared).select(F.col("chat_id").alias("_gone")).distinct()
    yes = owned(requests, chats, shared).select(F.col("chat_id").alias("_chat"), F.col("owner").alias("_by"), F.lit(True).alias("_ok")).distinct()
    told = requests.join(yes, (F.col("chat_id") == F.col("_chat")) & F.col("owner").eqNullSafe(F.col("_by")), "left").select(*requests.columns, F.coalesce("_ok", F.lit(False)).alias("ok"))
    return chats.join(gone, F.col("id") == F.col("_gone"), "left_anti"), messages.join(gone, F.col("chat_id") == F.col("_gone"), "left_anti"), told


def route_asks(asks: DataFrame, chats: DataFrame, shared: bool = False) -> DataFrame:
    """``asks (ask_id, chat_id, owner, ...)`` with ``target``: the chat if owned, else a new key made from the ask."""
    mine = owned(asks, chats, shared).select("ask_id").distinct().withColumn("_mine", F.lit(True))
    rows = asks.join(mine, "ask_id", "left")
    target = F.when(F.col("_mine"), F.col("chat_id").cast("string")).otherwise(F.concat(F.lit("new-"), F.col("ask_id").cast("string")))
    return rows.withColumn("is_new", F.col("_mine").isNull()).withColumn("target", target).drop("_mine")

"""Small helpers that several operators share: names, checkpoints, classes of links."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.readers import shared_folder

#: Edges that are worth a task of their own.
TASK_EDGES = 20_000
#: Bits of a table of ids for each id, and at most.
ID_BITS, MOST_ID_BITS = 16, 1 << 26
#: Spark's setting for the removal of shuffle files at the end of an action.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_kept: dict[tuple[str, str], Any] = {}


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def once(df: DataFrame) -> DataFrame:
    """``df`` for one action, whose shuffle files Spark removes when it ends; others stay on disk until the driver collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*")  # a frame of its own, as the setting is read when a frame is made
    finally:
        if before is None:
            conf.unset(SHUFFLE_CLEANUP)
        else:
            conf.set(SHUFFLE_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs no recomputation and what was shuffled
    on the way to it can go."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return once(df).checkpoint()


def gone(*frames: DataFrame) -> None:
    """Removes the files of frames that ``cut`` has kept and that nothing will read any more; Spark removes them when the driver
    collects garbage, if it is told to at all."""
    for df in frames:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def collected(df: DataFrame) -> pa.Table:
    """The rows of ``df``, which are few enough for the driver; no file of theirs stays."""
    rows = cut(df)
    out = rows.toArrow()
    gone(rows)
    return out


def bit_table(words: DataFrame, bits: int) -> np.ndarray:
    """A table of ``bits`` bits as 64-bit integers, of which those in the column ``slot`` of ``words`` are set."""
    word = F.shiftright("slot", 6).alias("word")
    found = collected(words.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("bits")))  # bits / 64 rows at most, as arrays
    table = np.zeros(bits // 64, np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table


def among(ids: DataFrame, count: int) -> Callable[[Column], Column]:
    """A test that is true for each of the ``count`` values of the only column of ``ids``, and for few others: they share a bit in a
    table of fixed size. Rows that fail it need not be shuffled to meet ``ids``."""
    bits = min(MOST_ID_BITS, 1 << max(10, (ID_BITS * count - 1).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    sent = ids.sparkSession.sparkContext.broadcast(bit_table(ids.select(slot(ids[ids.columns[0]]).alias("slot")), bits))

    @F.arrow_udf("boolean")
    def test(slot: pa.Array) -> pa.Array:
        at = slot.to_numpy(zero_copy_only=False)
        return pa.array((sent.value[at >> 6] >> (at & 63)) & 1 == 1)

    return lambda c: test(slot(c))


def kept(owner: str, key: str, make: Callable[[], Any]) -> Any:
    """``make()``, kept in this Python worker for later tasks of ``owner``; what other operators keep there goes."""
    takes_over(owner)
    if (owner, key) not in _kept:
        _kept[owner, key] = make()
    return _kept[owner, key]


def takes_over(owner: str) -> None:
    """A task of ``owner`` begins in this Python worker, which serves one operator after another: what others keep goes, and
    so does the memory that Arrow holds for reuse."""
    others = [k for k in _kept if k[0] != owner]
    for k in others:
        del _kept[k]
    if others:
        pa.default_memory_pool().release_unused()


def held_out(doc_id) -> "F.Column":
    """True for rows whose labels are never learned: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1, F.lit(False))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected ``edges``: one row ``(node, root)`` per node, root the smallest node.

    Alternates large-star and small-star steps (each a min per node and a join), so no component is ever
    gathered in one task; the loop ends when the edge set no longer changes. Null ends are dropped.
    Each step deals its edges by their node once, for the min and for the join, in tasks of ``TASK_EDGES`` or more.
    """
    ends = lambda *pairs: F.explode(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs])).alias("e")
    packed = lambda df: df.coalesce(max(1, mark[0] // TASK_EDGES))
    least = lambda dealt: packed(dealt.join(dealt.groupBy("u").agg(F.min("v").alias("m")), "u"))
    look = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    mark = look(e)
    while mark[0]:
        low = least(packed(e).select(ends(("u", "v"), ("v", "u"))).select("e.*").repartition("u"))
        e = low.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u > v")
        near = least(e.repartition("u"))
        e = cut(packed(near.select(ends(("v", "m"), ("u", "m"))).select("e.*").where("u > v").distinct()))
        now = look(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

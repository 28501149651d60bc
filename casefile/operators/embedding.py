"""Embedding columns and comparing embeddings and rankings."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine

#: Texts whose vectors a worker keeps after their rows have gone out.
RECENT = 1024


def feature_hashing(dim: int = 64) -> Callable[[list[str]], list[np.ndarray]]:
    """A deterministic embedder: signed counts of hashed words, scaled to length 1."""

    def embed(texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            v = np.zeros(dim, np.float32)
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1 if h >> 31 else -1
            out.append(v / (np.linalg.norm(v) or 1))
        return out

    return embed


def embed_column(df: DataFrame, column: str, make_embedder: Callable[[], Callable] = feature_hashing, out: str = "vec", batch: int = 64) -> DataFrame:
    """``df`` with the vector of ``column``. The embedder is made once per worker and gets ``batch`` texts at a time, across the
    borders of Arrow's batches, equal texts of neighbouring rows once (``RECENT`` texts are remembered); a reply that fails or is short is asked for again one
    text at a time. Null or empty texts get null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make_embedder()
        held: deque[pd.Series] = deque()  # whose rows wait for vectors
        done: dict[str, np.ndarray] = {}  # of texts in held and of recent ones, the oldest first
        todo: dict[str, None] = {}  # texts to embed, in order

        def ask(n: int) -> None:
            some = list(todo)[:n]
            try:
                got = embed(some)
            except Exception:
                got = []
            if len(got) != len(some):
                got = [embed([t])[0] for t in some]
            for t, v in zip(some, got, strict=True):
                done[t] = np.asarray(v, np.float32)
                del todo[t]

        def ready() -> Iterator[pd.Series]:
            while held and all(not t or t in done for t in held[0]):
                part = held.popleft()
                yield pd.Series([done[t] if t else None for t in part], dtype=object)
                if len(done) > RECENT:
                    kept = {t for p in held for t in p if t}
                    for t in [t for t in done if t not in kept][: len(done) - RECENT]:
                        del done[t]

        for part in parts:
            held.append(part)
            for t in part:
                if t and t not in done:
                    todo[t] = None
            while len(todo) >= batch:
                ask(batch)
            yield from ready()
        if todo:
            ask(len(todo))
        yield from ready()

    return df.withColumn(out, run(F.col(column)))


def vector_agreement(a: DataFrame, b: DataFrame, key: str = "id", vec: str = "vec") -> DataFrame:
    """One row: mean and least cosine of two embeddings of the same keys."""
    both = a.select(key, F.col(vec).alias("va")).join(b.select(key, F.col(vec).alias("vb")), key)
    sim = both.select(cosine(F.col("va"), F.col("vb")).alias("sim"))
    return sim.agg(F.avg("sim").alias("mean_cosine"), F.min("sim").alias("min_cosine"))


def topk_overlap(a: DataFrame, b: DataFrame, k: int = 8, query: str = "query_id", item: str = "decision_id") -> DataFrame:
    """One row: the mean over the queries of ``a`` of the share of their first ``k`` that ``b`` has in its first ``k``."""
    top = lambda d: d.where(F.col("rank") <= k).select(query, item).distinct()
    common = top(a).join(top(b).withColumn("_hit", F.lit(1)), [query, item], "left").groupBy(query).agg((F.count("_hit") / F.lit(k)).alias("share"))
    return common.agg(F.avg("share").alias("overlap"))


def rounded(c: Column) -> Column:
    """A similarity to 12 places, so that the order of summation cannot change a rank."""
    return F.round(c, 12)

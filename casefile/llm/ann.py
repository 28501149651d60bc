"""Approximate nearest neighbours by cosine: anisotropic product quantisation, table scans, exact reranking.

Vectors are scaled to length 1, so cosine is the inner product. They are dealt into cells, pairs of a centroid of the
first and one of the second half of the dimensions, so that few centroids name as many cells as the table needs: their
number grows with the table and cells keep their size. Each vector is encoded with four bits per pair of dimensions.
Codes and code books minimise a score-aware error: the part of the residual parallel to the vector, which changes large
inner products most, weighs ``eta`` times the rest. A query looks at its nearest cells: one table of 16 entries per pair
of dimensions scores all codes there. The best ``rerank`` are scored exactly on the original vectors, then, in blocks,
all others whose code score is within the length of their residual of the k-th exact score so far: nothing in the cells
looked at is lost by its code. How many cells that is follows from ``PROBE_QUERIES`` queries searched exactly.

Code books are fitted on at most ``SAMPLE`` vectors (those of the smallest hash of the id); every vector is indexed.
Of the copies of a vector only the k + 1 of the smallest ids can be neighbours; they are scanned once, and so are copies
of a query's vector. Large cells, and large sets of queries of a cell, are split into blocks that are scanned on their own.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, as query or candidate,
nor do vectors of another width than most; vectors are scaled by powers of two before their lengths are taken, so that
large and tiny components neither overflow nor vanish; equal scores go to the smaller id; null ids take no part; rows
that share an id, repeated rows among them, are each candidates under it and each queries, and only a query's own row is
no neighbour of it; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import cut

SAMPLE, CELL_ROWS, BLOCK_ROWS, BLOCK_QUERIES = 20_000, 1_000, 20_000, 20_000
#: Queries searched exactly to learn how many cells to look at, rows of a table that may be broadcast.
PROBE_QUERIES, BROADCAST_ROWS = 256, 250_000
#: Vectors scored exactly at a time, beyond the first ``rerank``.
RERANK_ROWS = 2_048


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 1) -> np.ndarray:
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        of = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
        count = np.bincount(of, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, of, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


class Index:
    """Coarse centroids and code books; ``encode`` gives the codes of unit vectors."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float = 0.2, sweeps: int = 3):
        self.dim = sample.shape[1]
        self.padded = self.dim + self.dim % 2
        x = self._pad(sample)
        self.eta = max(1.0, (self.dim - 1) * threshold**2 / (1 - threshold**2))
        self.side = max(1, min(round(math.sqrt(n / CELL_ROWS)), len(sample) // 8))
        self.halves = [_kmeans(h, self.side, 8) for h in self._halves(sample)]
        parts = x.reshape(len(x), -1, 2)
        k = min(16, len(x))
        self.books = np.stack([_kmeans(parts[:, m], k, 6, m) for m in range(parts.shape[1])])
        if k < 16:
            self.books = np.concatenate([self.books, np.repeat(self.books[:, :1], 16 - k, 1)], 1)
        for _ in range(3):
            self._refit(parts, self.encode(sample, sweeps))

    def _pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.padded - self.dim)))

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : (self.dim + 1) // 2], x[:, (self.dim + 1) // 2 :]

    def far(self, x: np.ndarray) -> list[np.ndarray]:
        """How far each vector's halves are from the halves' centroids (squares, less the vector's own length)."""
        return [(c**2).sum(1)[None] - 2 * h @ c.T for h, c in zip(self._halves(x), self.halves, strict=True)]

    def cell(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The ``n`` nearest cells of each vector."""
        t = min(self.side, n)
        out = np.empty((len(x), min(n, t * t)), np.int64)
        rows = max(1, (1 << 22) // (t * t))
        for lo in range(0, len(x), rows):
            a, b = self.far(x[lo : lo + rows])
            i, j = np.argsort(a, 1, kind="stable")[:, :t], np.argsort(b, 1, kind="stable")[:, :t]
            both = (np.take_along_axis(a, i, 1)[:, :, None] + np.take_along_axis(b, j, 1)[:, None]).reshape(len(a), -1)
            best = np.argsort(both, 1, kind="stable")[:, : out.shape[1]]
            out[lo : lo + rows] = np.take_along_axis(i, best // t, 1) * self.side + np.take_along_axis(j, best % t, 1)
        return out

    def places(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells are nearer to each vector than the one given."""
        a, b = self.far(x)
        out = np.empty(len(x), np.int64)
        for k, c in enumerate(cells.tolist()):
            out[k] = np.searchsorted(np.sort(b[k]), a[k, c // self.side] + b[k, c % self.side] - a[k], "left").sum()
        return out

    def encode(self, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """Codes that minimise |r|^2 + (eta - 1) (x . r)^2 over residuals r, one pair of dimensions at a time."""
        parts = self._pad(x).reshape(len(x), -1, 2)
        codes = np.stack([((parts[:, m, None] - self.books[m][None]) ** 2).sum(2).argmin(1) for m in range(parts.shape[1])], 1)
        along = np.stack([((parts[:, m] - self.books[m][codes[:, m]]) * parts[:, m]).sum(1) for m in range(parts.shape[1])], 1)
        total = along.sum(1)
        for _ in range(sweeps):
            for m in range(parts.shape[1]):
                r = parts[:, m, None] - self.books[m][None]
                dot = (r * parts[:, m, None]).sum(2)
                best = ((r**2).sum(2) + (self.eta - 1) * (total[:, None] - along[:, m, None] + dot) ** 2).argmin(1)
                new = dot[np.arange(len(x)), best]
                total += new - along[:, m]
                along[:, m], codes[:, m] = new, best
        return codes.astype(np.uint8)

    def _refit(self, parts: np.ndarray, codes: np.ndarray) -> None:
        """Code book entries that minimise the same error for fixed codes: a 2 x 2 system each."""
        for m in range(parts.shape[1]):
            along = sum(((parts[:, j] - self.books[j][codes[:, j]]) * parts[:, j]).sum(1) for j in range(parts.shape[1]) if j != m)
            x, lam = parts[:, m], self.eta - 1
            left = np.zeros((16, 2, 2)) + 1e-9 * np.eye(2)
            right = np.zeros((16, 2))
            np.add.at(left, codes[:, m], np.eye(2)[None] + lam * x[:, :, None] * x[:, None])
            np.add.at(right, codes[:, m], x * (1 + lam * (along + (x**2).sum(1)))[:, None])
            some = np.bincount(codes[:, m], minlength=16) > 0
            self.books[m][some] = np.linalg.solve(left[some], right[some][..., None])[..., 0]

    def error(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far the code score of each unit vector can be from its inner product with any unit vector."""
        total = np.zeros(len(x))
        for m, part in enumerate(np.moveaxis(self._pad(x).reshape(len(x), -1, 2), 1, 0)):
            total += ((part - self.books[m][codes[:, m]]) ** 2).sum(1)
        return np.sqrt(total) + 1e-6 * self.books.shape[0]  # tables and their sums are float32

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of every query's pairs of dimensions with the code book entries."""
        return np.einsum("qmd,mkd->qmk", self._pad(queries).reshape(len(queries), -1, 2), self.books).astype(np.float32)


def _vectors(column) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    return np.asarray(array.flatten().to_numpy(zero_copy_only=False), float).reshape(len(array), -1) if len(array) else np.zeros((0, 1))


def _best(score: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest, the first of equal ones."""
    if len(score) <= n:
        return np.arange(len(score))
    least = np.partition(score, len(score) - n)[len(score) - n]
    above = np.flatnonzero(score > least)
    return np.concatenate([above, np.flatnonzero(score == least)[: n - len(above)]])


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two, which changes no cosine: the largest component is between 1/2 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if len(x) else x


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _checked(df: DataFrame) -> DataFrame:
    """``df`` kept in the shared folder, marked for broadcast if it has few enough rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _probes(index: Index, shared, each: DataFrame, ask: DataFrame, k: int, recall: float) -> int:
    """Cells to look at so that ``recall`` of the exact neighbours of ``PROBE_QUERIES`` queries are in them."""
    some = ask.select("key", "v").orderBy("key").limit(PROBE_QUERIES).toPandas()
    if not len(some) or index.side == 1:
        return 1
    queries = _unit(np.array(some["v"].tolist(), float))
    own = [bytes(x) for x in some["key"]]
    sent = ask.sparkSession.sparkContext.broadcast((queries, own))

    def search(batches):
        q, own = sent.value
        best, cells = np.full((len(q), k), -2.0), np.zeros((len(q), k), np.int64)
        number = {x: i for i, x in enumerate(own)}
        for batch in batches:
            x = _unit(_vectors(batch.column("v")))
            sims, cell = q @ x.T, batch.column("cell").to_numpy()
            for j, key in enumerate(batch.column("key").to_pylist()):
                if key in number:
                    sims[number[key], j] = -2
            sims, cell = np.hstack([best, sims]), np.hstack([cells, np.broadcast_to(cell, (len(q), len(cell)))])
            top = np.argpartition(-sims, k - 1, 1)[:, :k]
            best, cells = np.take_along_axis(sims, top, 1), np.take_along_axis(cell, top, 1)
        at, rank = np.nonzero(best > -2)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(best[at, rank]), pa.array(cells[at, rank])], ["q", "sim", "cell"])

    near = each.select("key", "v", "cell").mapInArrow(search, "q long, sim double, cell long")
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "cell")
    near = near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).toPandas()  # k rows a query
    if not len(near):
        return 1
    return int(np.quantile(index.places(queries[near["q"]], near["cell"].to_numpy()), recall, method="higher")) + 1


def nearest(vectors: DataFrame, queries: Column, id: str = "vec_id", vec: str = "embedding", k: int = 5, rerank: int = 120, recall: float = 0.98) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` nearest found of every row that ``queries`` holds for.

    ``recall``: the share of the exact neighbours of some queries that lie in the cells that a query looks at; so many
    cells are looked at (8 at least)."""
    kind, id_kind = vectors.schema[vec].dataType, vectors.schema[id].dataType.simpleString()
    v = F.col(vec) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)) else F.col(vec).cast("array<double>")
    fine = vectors.where(F.col(id).isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0)).select(F.col(id).alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    fine = fine.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    widths = fine.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if widths is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {id_kind}, rank int, {id} {id_kind}, score double")
    fine = fine.where(F.size("v") == widths["width"])
    sample = fine.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).select("v").toPandas()
    index = Index(_unit(np.array(sample["v"].tolist(), float)), widths["count"])
    shared = vectors.sparkSession.sparkContext.broadcast(index)  # at most SAMPLE / 4 halves of centroids, 16 entries a pair

    def encode(batches):
        for batch in batches:
            raw = _vectors(batch.column("v"))
            x = _unit(raw)
            codes = shared.value.encode(x)
            packed = np.ascontiguousarray(codes[:, ::2] | (np.pad(codes[:, 1::2], ((0, 0), (0, codes.shape[1] % 2))) << 4))
            keys = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in raw + 0.0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.cell(x)[:, 0]), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(keys, pa.binary())], names=[*batch.schema.names, "cell", "codes", "key"])

    fine = fine.withColumn("row", F.monotonically_increasing_id())  # kept with the codes, so that it is drawn once
    coded = cut(fine.mapInArrow(encode, T.StructType([*fine.schema, T.StructField("cell", T.LongType()), T.StructField("codes", T.BinaryType()), T.StructField("key", T.BinaryType())])))
    # Copies of a vector: one row, with those of the smallest ids that can be among k nearest.
    first = coded.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id", "row"))).where(F.col("n") <= k + 1)
    each = cut(first.groupBy("key").agg(*[F.first(c).alias(c) for c in ("v", "cell", "codes")], F.array_sort(F.collect_list(F.struct("id", "row"))).alias("copies")))
    ask = cut(coded.where("asks").select("key", "v").dropDuplicates(["key"]))
    probes = min(index.side**2, max(8, _probes(index, shared, each, ask, k, recall)))

    def probed(batches):
        for batch in batches:
            cells = shared.value.cell(_unit(_vectors(batch.column("v"))), probes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.tolist(), pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

    ask = ask.mapInArrow(probed, T.StructType([*ask.schema, T.StructField("cells", T.ArrayType(T.LongType()))])).select("key", "v", F.explode("cells").alias("cell"))
    sizes = each.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    asked = ask.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("parts"))
    held = _checked(sizes.join(asked, "cell"))
    hashed = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    data = each.join(held, "cell").select("v", "codes", "copies", "cell", hashed("blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    ask = ask.join(held, "cell").select("key", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), hashed("parts").alias("part"))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            x, own = _scaled(_vectors(left.column("v"))), right.column("key").to_pylist()
            copies = [[(c["id"], c["row"]) for c in some] for some in left.column("copies").to_pylist()]
            packed = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(left.num_rows, -1)
            codes = np.empty((len(x), packed.shape[1] * 2), np.uint8)
            codes[:, ::2], codes[:, 1::2] = packed & 15, packed >> 4
            norm = np.sqrt((x * x).sum(1))
            error = shared.value.error(x / norm[:, None], codes)
            codes = np.ascontiguousarray(codes.T)
            asks = _scaled(_vectors(right.column("v")))
            for lo in range(0, len(asks), 128):
                q = asks[lo : lo + 128]
                length = np.sqrt((q * q).sum(1))
                table = shared.value.tables(q / length[:, None])
                approx = np.zeros((len(q), len(x)), np.float32)
                for m in range(table.shape[1]):
                    approx += table[:, m][:, codes[m]]
                for j, row in enumerate(approx):
                    top, most, got = _best(row, rerank), row + error, []
                    open_ = np.ones(len(x), bool)
                    while len(top):
                        open_[top] = False
                        exact = (x[top] * q[j]).sum(1) / (norm[top] * length[j])
                        for p in np.argsort(-exact, kind="stable").tolist():
                            if len(got) > k and exact[p] < got[k][0]:
                                break
                            got += [(float(exact[p]), *c) for c in copies[top[p]]]
                            got.sort(key=lambda s: (-s[0], s[1], s[2]))
                            del got[k + 1 :]
                        rest = np.flatnonzero(open_ & (most >= got[k][0])) if len(got) > k else np.flatnonzero(open_)
                        top = rest[_best(most[rest], RERANK_ROWS)]
                    for s, i, r in got:
                        for column, value in zip(found, (own[lo + j], i, r, s), strict=True):
                            column.append(value)
        ids = left.schema.field("copies").type.value_type.field("id").type
        return pa.table([pa.array(found[0], pa.binary()), pa.array(found[1], ids), pa.array(found[2], pa.int64()), pa.array(found[3], pa.float64())], names=["key", "id", "row", "score"])

    keys = ["cell", "block", "part"]
    hits = data.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInArrow(scan, f"key binary, id {id_kind}, row long, score double")
    w = Window.partitionBy("key").orderBy(F.desc("score"), "id", "row")
    hits = hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    best = hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "id", "row", "score"))).alias("hits"))
    # Of k + 1 neighbours of a vector, a query leaves out its own row, or the last.
    rows = coded.where("asks").select("key", F.col("id").alias("query_id"), F.col("row").alias("own")).join(best, "key")
    others = F.slice(F.filter("hits", lambda h: h["row"] != F.col("own")), 1, k)
    return rows.select("query_id", F.posexplode(others).alias("n", "h")).select("query_id", (F.col("n") + 1).alias("rank"), F.col("h.id").alias(id), F.col("h.score").alias("score"))

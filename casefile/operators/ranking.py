"""Hybrid ranking of chunks for a table of queries: cosine, keywords, numbers and explicit references."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import numbers, textnorm
from ..functions.vectors import cosine
from .embedding import rounded
from .postings import Index, as_index, token_hits

#: Bytes of query vectors that a task holds at a time, and queries at most; similarities that it holds at a time.
BLOCK_BYTES, BLOCK_QUERIES, SIMS = 32 << 20, 4_096, 1 << 21
#: Chunks that are streamed past a block of queries where there are several blocks, and pairs of a referenced decision in a task.
STRIP_ROWS, PAIRS = 4_000_000, 1_000_000
#: Pairs in a batch of all similarities; forced entries up to which they are broadcast to the scored ones.
PAIR_ROWS, BROADCAST_FORCED = 1 << 16, 250_000
KEYWORD, NUMBER, REFERENCE = 0.03, 0.25, 1.0


def _unit(column) -> np.ndarray:
    """The vectors of a column, which have one width, over their lengths."""
    array = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(array.flatten().to_numpy(zero_copy_only=False), float).reshape(len(array), -1)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n == 0, 1, n)


def _comparable(rows: DataFrame, width: int | None = None) -> DataFrame | tuple[DataFrame, int, int]:
    """Rows whose ``vec`` is finite and of ``width``, the width (by default the largest there is), and how many rows have that."""
    fine = rows.where(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    if width:
        return fine.where(F.size("vec") == width)
    first = fine.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("width")).first()
    width, count = first or (1, 0)
    return fine.where(F.size("vec") == width), width, count


def _past(asked: DataFrame, count: int, rows: DataFrame, width: int, make: Callable[[pa.Table], object], schema: T.StructType) -> DataFrame:
    """Every chunk of ``rows`` past every query of ``asked`` (``count`` rows at most), which has a ``vec`` and what ``make`` needs.

    ``make(queries)`` gives an object with ``add(rows)``, which may give batches of the result, and ``result()``. Queries that fit one block are broadcast, and
    chunks stay where they are. More queries are dealt into parts and chunks into strips: a partition holds a part's
    queries first and then a strip's chunks, which stream by, so that one pass serves all queries and a task
    holds one block of them."""
    spark = asked.sparkSession
    block = max(1, min(BLOCK_QUERIES, BLOCK_BYTES // (8 * width)))
    if not count:
        return spark.createDataFrame([], schema)
    if count <= block:
        sink = pa.BufferOutputStream()
        table = asked.toArrow()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = make(pa.ipc.open_stream(sent.value).read_all())
            for batch in batches:
                yield from held.add(pa.Table.from_batches([batch])) or ()
            yield from held.result().to_batches()

        return rows.mapInArrow(run, schema)

    total = rows.count()
    strips = max(1, math.ceil(total / STRIP_ROWS), min(spark.sparkContext.defaultParallelism, total // 1_024))
    parts = math.ceil(count / block)
    q, c = asked.columns, rows.columns
    number = lambda df, n: F.pmod(F.xxhash64(F.to_json(F.struct(*df.columns))), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    empty = lambda df: [F.lit(None).cast(f.dataType).alias(f"{'q' if df is asked else 'c'}_{f.name}") for f in df.schema]
    one = asked.withColumn("_part", number(asked, parts)).select("_part", each(strips).alias("_strip"), F.lit(0).alias("_kind"), *[F.col(x).alias(f"q_{x}") for x in q], *empty(rows))
    two = rows.withColumn("_strip", number(rows, strips)).select("_strip", each(parts).alias("_part"), F.lit(1).alias("_kind"), *[F.col(x).alias(f"c_{x}") for x in c], *empty(asked))
    both = one.unionByName(two).withColumn("_group", F.col("_strip") * parts + F.col("_part")).drop("_strip", "_part").repartition(strips * parts, "_group").sortWithinPartitions("_group", "_kind")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, queries, held = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            of, kind = (table.column(n).to_numpy() for n in ("_group", "_kind"))
            cuts = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0))
            for lo, hi in zip(cuts, [*cuts[1:], len(of)], strict=True):
                part = table.slice(lo, hi - lo)
                if of[lo] != group:
                    if held:
                        yield from held.result().to_batches()
                    group, queries, held = of[lo], [], None
                if not kind[lo]:
                    queries.append(part.select([f"q_{x}" for x in q]).rename_columns(q))
                elif queries:
                    held = held or make(pa.concat_tables(queries))
                    yield from held.add(part.select([f"c_{x}" for x in c]).rename_columns(c)) or ()
        if held:
            yield from held.result().to_batches()

    return both.mapInArrow(stream, schema)


class _Top:
    """The n best chunks of each query so far: similarity, then decision and place."""

    def __init__(self, queries: pa.Table, n: int):
        self.ids, self.matrix, self.n = queries.column("query_id"), _unit(queries.column("vec")), n
        self.low = np.full(len(self.ids), -np.inf)
        self.at, self.sim, self.idx, self.names = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32), pa.array([], pa.string())
        self.more: list = []
        self.waiting = 0

    def add(self, rows: pa.Table) -> None:
        if not rows.num_rows or not len(self.ids):
            return
        names, places, x = rows.column("decision_id").combine_chunks(), rows.column("idx").to_numpy(), _unit(rows.column("vec"))
        step = max(1, SIMS // len(x))
        for lo in range(0, len(self.matrix), step):
            sims = np.round(self.matrix[lo : lo + step] @ x.T, 12)
            low = self.low[lo : lo + step]
            if len(x) > self.n:
                low = np.maximum(low, np.partition(sims, len(x) - self.n, axis=1)[:, len(x) - self.n])
            at, c = np.nonzero(sims >= low[:, None])  # all that equal the n-th too
            self.more.append((at + lo, sims[at, c], places[c], names.take(pa.array(c))))
            self.waiting += len(at)
            if self.waiting > max(SIMS, len(self.at)):
                self.merge()

    def merge(self) -> None:
        parts = [(self.at, self.sim, self.idx, self.names), *self.more]
        at, sim, idx = (np.concatenate([p[i] for p in parts]) for i in range(3))
        names = pa.concat_arrays([p[3] for p in parts])
        order = np.lexsort((idx, pc.rank(names, tiebreaker="dense").to_numpy(), -sim, at))
        sorted_at = at[order]
        order = order[np.arange(len(order)) - np.searchsorted(sorted_at, sorted_at) < self.n]
        self.at, self.sim, self.idx, self.names, self.more, self.waiting = at[order], sim[order], idx[order], names.take(pa.array(order)), [], 0
        ends = np.searchsorted(self.at, np.arange(len(self.ids)), "right")
        full = np.bincount(self.at, minlength=len(self.ids)) == self.n
        self.low[full] = self.sim[ends[full] - 1]

    def result(self) -> pa.Table:
        self.merge()
        return pa.table([self.ids.take(pa.array(self.at)), self.names, pa.array(self.idx, pa.int32()), pa.array(self.sim)], names=["query_id", "decision_id", "idx", "sim"])


class _All:
    """The similarity of every chunk to each query, given at once: nothing is held."""

    def __init__(self, queries: pa.Table):
        self.ids, self.matrix = queries.column("query_id").combine_chunks(), _unit(queries.column("vec"))

    def add(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows or not len(self.ids):
            return
        names, places, x = rows.column("decision_id").combine_chunks(), rows.column("idx").combine_chunks(), _unit(rows.column("vec"))
        step = max(1, PAIR_ROWS // len(x))
        for lo in range(0, len(self.matrix), step):
            for at in range(0, len(x), PAIR_ROWS):
                sims = np.round(self.matrix[lo : lo + step] @ x[at : at + PAIR_ROWS].T, 12)
                q, c = (pa.array(i.ravel()) for i in np.indices(sims.shape))
                some = pc.add(c, at)
                yield pa.RecordBatch.from_arrays([self.ids.take(pc.add(q, lo)), names.take(some), places.take(some), pa.array(sims.ravel())], ["query_id", "decision_id", "idx", "sim"])

    def result(self) -> pa.Table:
        return pa.table({})


def _found(queries: DataFrame) -> T.StructType:
    return T.StructType([queries.schema["query_id"], T.StructField("decision_id", T.StringType()), T.StructField("idx", T.IntegerType()), T.StructField("sim", T.DoubleType())])


def similarities(queries: DataFrame, chunks: DataFrame | Index) -> DataFrame:
    """``(query_id, decision_id, idx, sim)`` of every query with every chunk: as many rows as pairs, made where the chunks are, without
    a sort or a shuffle of pairs. Vectors take part as in ``vector_topn``."""
    asked, width, count = _comparable(queries.select("query_id", "vec"))
    rows = _comparable(as_index(chunks, vectors_only=True).vectors.where("decision_id is not null and idx is not null").select("decision_id", "idx", "vec"), width)
    return _past(asked, count, rows, width, _All, _found(queries))


def vector_topn(queries: DataFrame, chunks: DataFrame | Index, n: int) -> DataFrame:
    """``(query_id, decision_id, idx, sim)``: each query's n chunks of the highest cosine.

    A task keeps the n best of each query over all batches that it reads; what the tasks have found is merged twice, in groups of
    tasks and then over the groups. Ties: decision_id, idx. Vectors that are null, hold null or non-finite components, or
    have another width than the widest query take no part, nor do chunks without a decision or a place in it."""
    asked, width, count = _comparable(queries.select("query_id", "vec"))
    rows = _comparable(as_index(chunks, vectors_only=True).vectors.where("decision_id is not null and idx is not null").select("decision_id", "idx", "vec"), width)
    found = _past(asked, count, rows, width, lambda table: _Top(table, n), _found(queries))
    order = [F.desc("sim"), "decision_id", "idx"]
    groups = math.isqrt(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if groups > 1:
        w = Window.partitionBy("query_id", "_group").orderBy(*order)
        found = found.withColumn("_group", F.spark_partition_id() % groups).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n", "_group")
    w = Window.partitionBy("query_id").orderBy(*order)
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def keyword_hits(tokens: Column, norm_text: Column) -> Column:
    """How many of the tokens occur in the text, as parts of words too."""
    # As a lambda's variable the text is normalized once, not once per token.
    return F.get(F.transform(F.array(norm_text), lambda n: F.size(F.filter(tokens, lambda t: F.contains(n, t)))), F.lit(0))


def number_boost(found: Column, number: Column) -> Column:
    """The bonus of a decision whose number's digits are among the query's numbers."""
    return F.when(F.array_contains(found, numbers.digits_of(number)), F.lit(NUMBER)).otherwise(F.lit(0.0))


def match_refs(queries: DataFrame, decisions: DataFrame) -> DataFrame:
    """``(query_id, decision_id)`` of explicit references; decisions without a number or year never match."""
    refs = queries.select("query_id", F.explode(textnorm.decision_refs(F.col("text"))).alias("r")).select("query_id", "r.number", "r.year").distinct()
    named = decisions.where((F.col("number") != "") & (F.col("year") != "")).select(F.col("id").alias("decision_id"), numbers.normalize_number(F.col("number")).alias("number"), "year")
    return refs.join(named, ["number", "year"]).select("query_id", "decision_id").distinct()


def force_refs(scored: DataFrame, refs: DataFrame, queries: DataFrame, chunks: DataFrame | Index) -> DataFrame:
    """``scored`` with each referenced decision's best chunk at its cosine and 1, in place of its entry there.

    A decision with many chunks that many queries name is cut into slices of its chunks, each with a copy of the queries, and
    the best chunk is a maximum of structs, taken in every task before the rows meet."""
    vectors = as_index(chunks, vectors_only=True).vectors.where("decision_id is not null and idx is not null").select("decision_id", "idx", "vec")
    counts = vectors.select("decision_id").join(refs.groupBy("decision_id").agg(F.count("*").alias("_r")), "decision_id").groupBy("decision_id", "_r").agg(F.count("*").alias("_c"))
    slices = counts.select("decision_id", F.least(F.ceil(F.col("_c") * F.col("_r").cast("double") / PAIRS), F.col("_c")).cast("int").alias("_slices"))
    asked = refs.join(queries.select("query_id", F.col("vec").alias("_q")), "query_id").join(slices, "decision_id").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    dealt = vectors.join(slices, "decision_id").withColumn("_slice", F.pmod(F.xxhash64("idx"), F.col("_slices")).cast("int")).drop("_slices")
    pairs = asked.join(dealt, ["decision_id", "_slice"]).select("query_id", "decision_id", "idx", rounded(cosine(F.col("_q"), F.col("vec"))).alias("sim")).where("sim is not null")
    best = pairs.groupBy("query_id", "decision_id").agg(F.max(F.struct("sim", (-F.col("idx")).alias("_minus"))).alias("_b"))
    best = best.select("query_id", "decision_id", (-F.col("_b._minus")).alias("idx"), F.col("_b.sim").alias("sim"), (F.col("_b.sim") + REFERENCE).alias("score"), F.lit(True).alias("forced"))
    # Scored entries may be very many: they stay where they are while the forced ones are few.
    few = refs.join(slices, "decision_id").limit(BROADCAST_FORCED + 1).count() <= BROADCAST_FORCED
    forced = best.select("query_id", "decision_id", "idx")
    return scored.join(F.broadcast(forced) if few else forced, ["query_id", "decision_id", "idx"], "left_anti").unionByName(best)


def rank_chunks(queries: DataFrame, chunks: DataFrame | Index, decisions: DataFrame, pool: int = 200) -> DataFrame:
    """``(query_id, decision_id, idx, sim, score, forced)`` of each query's pool and referenced decisions.

    Keyword hits come from the index's postings: no text of a chunk is read."""
    index = as_index(chunks)
    tokens = queries.select("query_id", textnorm.search_tokens(F.col("text")).alias("tokens"))
    rows = token_hits(vector_topn(queries, index, pool), tokens, index)
    rows = rows.join(queries.select("query_id", textnorm.query_numbers(F.col("text")).alias("_numbers")), "query_id")
    rows = rows.join(decisions.select(F.col("id").alias("decision_id"), "number"), "decision_id", "left")
    score = F.col("sim") + KEYWORD * F.col("hits") + number_boost(F.col("_numbers"), F.col("number"))
    scored = rows.select("query_id", "decision_id", "idx", "sim", rounded(score).alias("score"), F.lit(False).alias("forced"))
    return force_refs(scored, match_refs(queries, decisions), queries, index)


def best_per_decision(scored: DataFrame, k: int) -> DataFrame:
    """One best chunk per decision, then each query's k best decisions, with ``rank``."""
    order = [F.desc("score"), F.desc("sim"), "decision_id", "idx"]
    one = scored.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "decision_id").orderBy(*order))).where("_n = 1").drop("_n")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


class _Above:
    """How many chunks so far are nearer to each query than its targets."""

    def __init__(self, queries: pa.Table):
        self.ids, self.matrix = queries.column("query_id"), _unit(queries.column("vec"))
        self.targets = [sorted((t["best"], t["decision_id"]) for t in some) for some in queries.column("targets").to_pylist()]
        self.bests = [np.array([b for b, _ in some]) for some in self.targets]
        self.above = [np.zeros(len(some) + 1, np.int64) for some in self.targets]

    def add(self, rows: pa.Table) -> None:
        x = _unit(rows.column("vec"))
        step = max(1, SIMS // max(1, len(x)))
        for lo in range(0, len(self.matrix), step):
            for q, sims in enumerate(np.round(self.matrix[lo : lo + step] @ x.T, 12), lo):
                # A similarity counts for all targets below it; the histogram is summed from above at the end.
                self.above[q] += np.bincount(np.searchsorted(self.bests[q], sims, "left"), minlength=len(self.above[q]))

    def result(self) -> pa.Table:
        at = np.repeat(np.arange(len(self.targets)), [len(t) for t in self.targets])
        counts = [np.cumsum(a[::-1])[::-1][1:] for a in self.above]
        return pa.table([self.ids.take(pa.array(at, pa.int64())), pa.array([d for t in self.targets for _, d in t], pa.string()), pa.array(np.concatenate(counts) if counts else [], pa.int64())], names=["query_id", "decision_id", "above"])


def target_rank(queries: DataFrame, chunks: DataFrame | Index, targets: DataFrame) -> DataFrame:
    """``(query_id, decision_id, target_rank)``: the cosine rank, over all chunks, of a wanted decision's best chunk.

    ``targets (query_id, decision_id)`` may hold many decisions per query: their best values are sorted, and every
    similarity is counted between two of them. Vectors take part as in ``vector_topn``."""
    asked, width, count = _comparable(queries.select("query_id", "vec"))
    vectors = _comparable(as_index(chunks, vectors_only=True).vectors.where("decision_id is not null and idx is not null").select("decision_id", "vec"), width)
    wanted = asked.withColumnRenamed("vec", "_q").join(targets.select("query_id", "decision_id").distinct(), "query_id")
    best = wanted.join(vectors, "decision_id").groupBy("query_id", "decision_id").agg(F.max(rounded(cosine(F.col("_q"), F.col("vec")))).alias("best"))
    best = best.where("best is not null").groupBy("query_id").agg(F.collect_list(F.struct("decision_id", "best")).alias("targets"))
    rows = asked.join(best, "query_id")
    schema = T.StructType([queries.schema["query_id"], T.StructField("decision_id", T.StringType()), T.StructField("above", T.LongType())])
    out = _past(rows, count, vectors.select("vec"), width, _Above, schema)
    return out.groupBy("query_id", "decision_id").agg((F.sum("above") + 1).alias("target_rank"))

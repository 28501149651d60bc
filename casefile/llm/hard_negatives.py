"""Hard negatives by Kronecker-packed integer products.

Components become the integers ``floor(256 x)``; scores are their exact inner products. Several candidates are packed into
one wide integer per dimension: their components, biased so that none is negative, stand in fields wide enough for a whole
inner product. One multiplication of such an integer by an anchor's biased component adds to the products of all its
candidates at once; at the end the fields are cut apart and the biases taken off. Integers of up to 53 bits are held in
doubles, whose sums of integers are exact then; where a field does not fit, Python's integers of any width take
their place.

Every anchor looks at every row: rows are dealt into strips and anchors into parts, a partition holds a part's anchors
first and then streams a strip's rows past them, batch by batch, keeping the ``k`` best of each anchor and range of scores. So
memory holds one part's anchors and one batch, however many rows have one label, and only ``k`` rows per anchor, range and strip
meet in the final window. Positives are searched among the strips of the anchor's label alone, negatives, for whose
scores the positives set the ranges, among all strips.

Defined results: rows with a null id, label or vector, an empty vector, null or non-finite components, or another width
than most take no part; equal scores go to the smaller id; rows that share an id, repeated rows among them, are each
candidates and each anchors, and only an anchor's own row is no positive of it; pairs whose score no 64-bit integer
holds have none and are left out; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut

#: Rows that are streamed past a part's anchors, anchors that a task holds, and least rows of a strip of a small table.
STRIP_ROWS, PART_ANCHORS, LEAST_STRIP = 4_000_000, 16_384, 1_024
#: Scores that a task holds at a time, and bits of the integers that a double holds exactly.
SCORES, EXACT_BITS = 1 << 21, 53
_LONG = (1 << 63) - 1


def _integers(column) -> np.ndarray:
    """``floor(256 x)`` of a column of vectors: doubles that hold integers, or Python's integers where a double doesn't hold 256 x exactly."""
    array = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(array.flatten().to_numpy(zero_copy_only=False), float).reshape(len(array), -1)
    if np.abs(x).max(initial=0) < 1 << 44:
        return np.floor(256 * x)
    return np.array([[int(c) * 256 if abs(c) > 1e300 else math.floor(256 * c) for c in row] for row in x.tolist()], object)


def packed_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, a line per anchor: int64, or Python's integers (object) if a field needs more bits."""
    low_a, low_r = int(anchors.min()), int(rows.min())
    most = anchors.shape[1] * (int(anchors.max()) - low_a) * (int(rows.max()) - low_r)
    bits = max(1, most.bit_length())
    narrow = bits <= EXACT_BITS and anchors.dtype != object and rows.dtype != object and anchors.shape[1] * int(np.abs(anchors).max()) * int(np.abs(rows).max()) < 1 << 60
    fields = EXACT_BITS // bits if narrow else 64
    n = len(rows)
    pad = -n % fields
    if narrow:
        a, r = anchors - low_a, np.pad(rows - low_r, ((0, pad), (0, 0)))
        words = (r.reshape(-1, fields, r.shape[1]) * (2.0 ** (bits * np.arange(fields)))[:, None]).sum(1)  # a wide integer per dimension
        sums = (a @ words.T).astype(np.int64)
        mask = np.int64((1 << bits) - 1)
        out = np.stack([(sums >> np.int64(bits * f)) & mask for f in range(fields)], 2).reshape(len(a), -1)[:, :n]
        a_sum, r_sum = a.sum(1).astype(np.int64), r[:n].sum(1).astype(np.int64)
    else:
        a, r = [[int(c) - low_a for c in row] for row in anchors.tolist()], [[int(c) - low_r for c in row] for row in rows.tolist()]
        mask, out = (1 << bits) - 1, np.empty((len(a), n), object)
        for lo in range(0, n, fields):
            some = r[lo : lo + fields]
            words = [sum(row[d] << (bits * f) for f, row in enumerate(some)) for d in range(anchors.shape[1])]
            for i, row in enumerate(a):
                total = sum(c * w for c, w in zip(row, words, strict=True))
                out[i, lo : lo + len(some)] = [(total >> (bits * f)) & mask for f in range(len(some))]
        a_sum, r_sum = np.array([sum(x) for x in a], object), np.array([sum(x) for x in r], object)
    # (a' + low_a)(r' + low_r), summed, less what the fields hold
    out = out + low_r * a_sum[:, None] + low_a * r_sum[None] + anchors.shape[1] * low_a * low_r
    if out.dtype == object and (not out.size or -_LONG <= min(map(min, out)) and max(map(max, out)) <= _LONG):
        out = out.astype(np.int64)
    return out


class _Best:
    """The k best rows of each anchor and range of scores, so far; ranges are inclusive."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low.copy(), high, k
        self.n = np.zeros(low.shape, np.int64)
        self.score, self.id, self.row = (np.zeros((*low.shape, k), np.int64) for _ in range(3))

    def add(self, w: int, at: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Rows found for anchors ``at`` in range number ``w``."""
        fits = (score >= self.low[at, w]) & (score <= self.high[at, w])
        at, score, ids, rows = at[fits], score[fits], ids[fits], rows[fits]
        if not len(at):
            return
        touched = np.unique(at)
        held = np.arange(self.k)[None] < self.n[touched, w][:, None]
        at = np.concatenate([np.repeat(touched, self.n[touched, w]), at])
        score, ids, rows = (np.concatenate([x[touched, w][held], y]) for x, y in ((self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, -score, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        order, at, place = order[place < self.k], at[place < self.k], place[place < self.k]
        for held, found in ((self.score, score), (self.id, ids), (self.row, rows)):
            held[at, w, place] = found[order]
        np.maximum.at(self.n[:, w], at, place + 1)
        full = touched[self.n[touched, w] == self.k]
        self.low[full, w] = self.score[full, w, -1]  # an equal score may have a smaller id


def _stream(anchors: DataFrame, rows: DataFrame, key: list[str], groups: int, k: int, same: bool) -> DataFrame:
    """``(own, w, id, row, score)``: the ``k`` best rows per anchor and range in each group of equal ``key``.

    ``anchors``: key, own, label, v, ranges (low, high); ``rows``: key, id, row, label, v."""
    one = anchors.select(*key, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.col("own").alias("row"), "label", "v", "ranges")
    two = rows.select(*key, F.lit(1).alias("kind"), "id", "row", "label", "v", F.lit(None).cast(anchors.schema["ranges"].dataType).alias("ranges"))
    both = one.unionByName(two).withColumn("group", F.struct(*key)).drop(*key).repartition(groups, "group").sortWithinPartitions("group", "kind", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, best = None, [], None

        def load(parts: list[pa.Table]):
            got = pa.concat_tables(parts)
            ranges = got.column("ranges").to_pylist()
            width = max(map(len, ranges))
            low, high = np.full((len(ranges), width), 1, np.int64), np.zeros((len(ranges), width), np.int64)
            for i, some in enumerate(ranges):
                for j, r in enumerate(some):
                    low[i, j], high[i, j] = r["low"], r["high"]
            vectors = [_integers(p.column("v")) for p in parts]
            return (np.concatenate(vectors), np.array(got.column("label").to_pylist(), object), got.column("row").to_numpy()), _Best(low, high, k)

        def look(anchor, best: _Best, part: pa.Table) -> None:
            vectors, labels, own = anchor
            x, ids, rows = _integers(part.column("v")), part.column("id").to_numpy(), part.column("row").to_numpy()
            names = {n: i for i, n in enumerate(set(labels))}
            mine, theirs = np.array([names[n] for n in labels]), np.array([names.get(n, -1) for n in part.column("label").to_pylist()])
            step = max(1, SCORES // len(x))
            for lo in range(0, len(vectors), step):
                hi = lo + step
                score = packed_products(vectors[lo:hi], x)
                open_ = (mine[lo:hi, None] == theirs[None]) == same
                if score.dtype == object:
                    open_ &= np.array((score <= _LONG) & (score >= -_LONG), bool)
                    score = np.where(open_, score, 0).astype(np.int64)
                open_ &= (score >= best.low[lo:hi].min(1)[:, None]) & (score <= best.high[lo:hi].max(1)[:, None])
                if same:
                    open_ &= own[lo:hi, None] != rows[None]
                at, c = np.nonzero(open_)
                for w in range(best.low.shape[1]):
                    best.add(w, at + lo, score[at, c], ids[c], rows[c])

        def found(anchor, best: _Best) -> Iterator[pa.RecordBatch]:
            at, w, place = np.nonzero(np.arange(k)[None, None] < best.n[:, :, None])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(anchor[2][at]), pa.array(w.astype(np.int32)), *(pa.array(x[at, w, place]) for x in (best.id, best.row, best.score))], ["own", "w", "id", "row", "score"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            names = [tuple(g.values()) for g in batch.column(batch.schema.get_field_index("group")).to_pylist()]
            kinds = batch.column(batch.schema.get_field_index("kind")).to_numpy()
            starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1] or kinds[i] != kinds[i - 1]), len(names)]
            for lo, hi in zip(starts, starts[1:], strict=False):
                if names[lo] != group:
                    if best:
                        yield from found(held, best)
                    group, held, best = names[lo], [], None
                part = table.slice(lo, hi - lo)
                if not kinds[lo]:
                    held.append(part)
                elif held:
                    if best is None:
                        held, best = load(held)
                    look(held, best, part)
        if best:
            yield from found(held, best)

    return both.mapInArrow(run, "own long, w int, id long, row long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each anchor and range over all strips, with ``rank``."""
    w = Window.partitionBy("own", "w").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _parts(n: Column, most: int) -> Column:
    return F.greatest(F.ceil(n / most), F.lit(1)).cast("int")


def _dealt(n: str) -> Column:
    return F.pmod(F.xxhash64("row"), F.col(n)).cast("int")


def _each(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def mine(vectors: DataFrame, anchors: Column, id: str = "vec_id", vec: str = "embedding", label: Column | str = "label", positives: int = 5, negatives: int = 5, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows that ``anchors`` holds for.

    An anchor's positives are its best rows of the same label; each positive's negatives are the best rows of other labels
    with ``least[0] * positive_score <= least[1] * negative_score <= least[1] * positive_score``. Ids are integers."""
    label = F.col(label) if isinstance(label, str) else label
    fine = vectors.select(F.col(id).cast("long").alias("id"), label.alias("label"), F.col(vec).cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    fine = fine.where("id is not null and label is not null and v is not null and size(v) > 0")
    fine = fine.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    fine = cut(fine.withColumn("row", F.monotonically_increasing_id()))  # kept, so that row numbers are drawn once
    widths = fine.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).orderBy(F.desc("n"), "width").first()
    if widths is None:
        width, n, asks = 1, 0, 0
    else:
        width, n, asks = widths
    fine = fine.where(F.size("v") == width)
    # A small table has a strip per core, and none of less than LEAST_STRIP rows.
    spread = max(1, min(vectors.sparkSession.sparkContext.defaultParallelism, n // LEAST_STRIP))
    strip_rows = max(1, min(STRIP_ROWS, math.ceil(n / spread)))
    strips, parts = max(1, math.ceil(n / strip_rows)), max(1, math.ceil(asks / PART_ANCHORS))

    labels = fine.groupBy("label").agg(_parts(F.count("*"), strip_rows).alias("strips"), _parts(F.count_if("asks"), PART_ANCHORS).alias("parts"), F.count_if("asks").alias("n")).where("n > 0").drop("n")
    told = fine.join(labels, "label")
    whole = F.array(F.struct(F.lit(-_LONG).alias("low"), F.lit(_LONG).alias("high")))
    asked = told.where("asks").select("label", F.col("row").alias("own"), "v", whole.alias("ranges"), _dealt("parts").alias("part"), _each("strips").alias("strip"))
    rows = told.select("label", "id", "row", "v", _dealt("strips").alias("strip"), _each("parts").alias("part"))
    keyed = lambda df: df.withColumn("of", F.col("label"))
    first = _first(_stream(keyed(asked), keyed(rows), ["of", "strip", "part"], max(strips, spread) * parts, positives, True), positives)
    first = cut(first.select("own", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    # The least n with least[0] p <= least[1] n, in integers: the quotient rounded up.
    p, x = F.col("positive_score"), f"cast(positive_score as decimal(20,0)) * -{least[0]}"
    low = F.expr(f"-(({x} - pmod({x}, {least[1]})) div {least[1]})").cast("long")
    ranges = first.groupBy("own").agg(F.array_sort(F.collect_list(F.struct("place", low.alias("low"), p.alias("high")))).alias("ranges"))
    ranges = ranges.withColumn("ranges", F.transform("ranges", lambda r: F.struct(r["low"].alias("low"), r["high"].alias("high"))))
    by_row = fine.where("asks").select(F.col("row").alias("own"), "row", "label", "v").join(ranges, "own")
    dealt = lambda df: df.withColumns({"strips": F.lit(strips), "parts": F.lit(parts)})
    asked = dealt(by_row).select("own", "label", "v", "ranges", _dealt("parts").alias("part"), _each("strips").alias("strip"))
    rows = dealt(fine).select("id", "row", "label", "v", _dealt("strips").alias("strip"), _each("parts").alias("part"))
    found = _first(_stream(asked, rows, ["strip", "part"], strips * parts, negatives, False), negatives)
    pairs = found.select("own", (F.col("w") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(first, ["own", "place"])
    names = fine.where("asks").select(F.col("row").alias("own"), F.col("id").alias("anchor_id"))
    return pairs.join(names, "own").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

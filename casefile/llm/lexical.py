"""Ranked lexical search of a set of items over all documents: pipelined term partitioning.

Terms are owned by ``owners`` partitions of the vocabulary, by hash. Items travel in bundles: a bundle carries, for one shard of
the documents, a sparse accumulator per item, the documents that have a score so far and their scores, through the owners
one after the other. At each owner a cogroup brings the bundle together with the owner's postings of that shard, and the
integer contributions are added. What comes out of the last owner gives each shard's first ``k`` documents of every item, and
a window the first ``k`` of all.

Documents are tokenised once. A task keeps the terms that items may hold, by a table of hashed terms whose size has a fixed
bound (``SLOTS``); other terms only count in a document's length. Document frequencies are counted from the postings of all
documents. Shards and bundles have bounded sizes, so no frequent term and no item gathers more than a shard's documents.

Scores: a term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))), N the documents with a term and df those with this one; all
else is in 64-bit integers, ``div`` rounding down: m = 75 + (25 n N) div L of a document of n terms, L being the terms of all
documents; a term that occurs tf times adds w ((1000000000 tf) div (1000 tf + 12 m)) for each of its occurrences in the item.

Defined results: terms are runs of letters and digits of any script, A to Z in small letters; null and empty texts have
none and rank nowhere, in N they don't count; long texts are read whole; equal scores go to the smaller id, null ids last; rows that share an id,
repeated rows among them, are each a document with a rank; items with a null id, text or without terms have no rows, items that share an id
are ranked each on its own under it; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import shared_folder

#: Places of the table of hashed terms, documents of a shard, and terms and items of a bundle, about.
SLOTS, SHARD_DOCS, BUNDLE_TERMS, BUNDLE_ITEMS = 1 << 22, 4_096, 10_000, 512
#: Contributions that are added at a time.
ADDS = 1 << 21
#: Letters and digits, and everything beyond ASCII, are parts of terms; all other bytes part them.
_APART = bytes(b if chr(b).isascii() and chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order. Bytes beyond ASCII are parts of letters that all belong to terms."""
    return text.lower().translate(_APART).split()


def _item_terms(items: DataFrame, id: str, text: str) -> DataFrame:
    """``(item, item_id, term, owner, repeats)``, one row per item and term; ``item`` numbers the items' rows."""
    kind = items.schema[id].dataType
    shape = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind), T.StructField("term", T.StringType()), T.StructField("repeats", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, ids, found = batch.column(0).to_pylist(), batch.column(1), [Counter(terms(x or b"")) for x in batch.column(2).cast(pa.binary()).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(c) for c in found])
            yield pa.RecordBatch.from_arrays([pa.array([numbers[i] for i in at], pa.int64()), ids.take(pa.array(at)), pa.array([t.decode() for c in found for t in c], pa.string()), pa.array([n for c in found for n in c.values()], pa.int64())], names=["item", "item_id", "term", "repeats"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id).alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id is not null and text is not null")
    return rows.mapInArrow(run, shape)


def _postings(docs: DataFrame, wanted: DataFrame, id: str, text: str, owners: int) -> DataFrame:
    """``(row, doc_id, n, terms, counts)``: per document and owner its terms that items may hold; ``owner`` -1 counts its length."""
    count = wanted.count()
    slots = min(SLOTS, 1 << max(16, (64 * count).bit_length()))
    # One place per different hash at most: the table that is sent has a fixed bound, whatever the items hold.
    places = wanted.select(F.expr(f"crc32(encode(term, 'UTF-8')) & {slots - 1}").cast("int").alias("p")).distinct()
    table = np.zeros(slots, np.uint8)
    table[places.toArrow().column("p").to_numpy()] = 1
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(table).tobytes())
    kind = docs.schema[id].dataType
    shape = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", kind), T.StructField("owner", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(np.frombuffer(sent.value, np.uint8))
        for batch in batches:
            numbers, ids, texts = batch.column(0).to_pylist(), batch.column(1), batch.column(2).cast(pa.binary())
            at, owner, size, words, counts, ends = [], [], [], [], [], [0]
            for i, value in enumerate(texts):
                found = terms(value.as_py() or b"")
                if not found:
                    continue
                at.append(i), owner.append(-1), size.append(len(found)), ends.append(len(words))
                by: dict[int, list] = defaultdict(list)
                for term, n in Counter(found).items():
                    h = zlib.crc32(term)
                    if held[h & (slots - 1)]:
                        by[(h >> 7) % owners].append((term, n))
                for o, some in by.items():
                    at.append(i), owner.append(o), size.append(len(found))
                    words.extend(t for t, _ in some), counts.extend(n for _, n in some), ends.append(len(words))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([numbers[i] for i in at], pa.int64()), ids.take(pa.array(at, pa.int64())), pa.array(owner, pa.int32()), pa.array(size, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(words, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))], names=shape.names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    made = rows.mapInArrow(run, shape)
    folder = f"{shared_folder(docs.sparkSession)}/postings-{uuid.uuid4().hex}"
    made.write.partitionBy("owner").parquet(folder)  # read by every owner's stage, and row numbers are drawn once
    return docs.sparkSession.read.schema(shape).parquet(folder)


_STATE = "bundle long, shard long, item long, docs array<long>, scores array<long>"


def _flat(t: pa.Table, c: str) -> np.ndarray:
    return np.asarray(t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False), np.int64)


def _sizes(t: pa.Table, c: str) -> np.ndarray:
    return np.asarray(pc.list_value_length(t.column(c)).to_numpy(), np.int64)


def _add(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items, documents and their scores (a line per item) after an owner's contributions; left: accumulators and the
    owner's weights, right: its postings."""
    items = np.unique(left.column("item").to_numpy())
    carried, weights = left.filter(pc.is_null(left.column("term"))), left.filter(pc.is_valid(left.column("term")))
    docs = np.unique(np.concatenate([_flat(t, c) if c == "docs" else t.column(c).to_numpy() for t, c in ((carried, "docs"), (right, "row")) if t.num_rows] or [np.zeros(0, np.int64)]))
    score = np.zeros((len(items), len(docs)), np.int64)
    if carried.num_rows:
        at = np.repeat(np.searchsorted(items, carried.column("item").to_numpy()), _sizes(carried, "docs"))
        score[at, np.searchsorted(docs, _flat(carried, "docs"))] = _flat(carried, "scores")
    if right.num_rows and weights.num_rows:
        # Weights by number of term: the items of a term stand together.
        coded = weights.column("term").combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy()
        order, many = np.argsort(code, kind="stable"), np.bincount(code, minlength=len(coded.dictionary))
        start = np.cumsum(many) - many
        item, weight = np.searchsorted(items, weights.column("item").to_numpy())[order], weights.column("weight").to_numpy()[order]
        term = pc.fill_null(pc.index_in(right.column("terms").combine_chunks().flatten(), value_set=coded.dictionary), -1).to_numpy()
        n = _sizes(right, "terms")
        doc, m, tf = np.repeat(np.searchsorted(docs, right.column("row").to_numpy()), n), np.repeat(right.column("m").to_numpy(), n), _flat(right, "counts")
        known = term >= 0  # other bundles have the other terms
        term, doc, value = term[known], doc[known], (1_000_000_000 * tf[known]) // (1000 * tf[known] + 12 * m[known])
        copies = many[term]  # one at least
        block = np.cumsum(copies) // ADDS
        cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-2))
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            c, t = copies[lo:hi], term[lo:hi]
            place = np.repeat(start[t] - np.cumsum(c) + c, c) + np.arange(c.sum())
            np.add.at(score, (item[place], np.repeat(doc[lo:hi], c)), weight[place] * np.repeat(value[lo:hi], c))
    return items, docs, score


def _pass_on(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The bundle with sparse accumulators, for the next owner."""
    items, docs, score = _add(left, right)
    at, doc = np.nonzero(score > 0)
    ends = np.searchsorted(at, np.arange(len(items) + 1))
    packed = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64()))
    same = lambda i: pa.array(np.full(len(items), key[i].as_py()), pa.int64())
    return pa.table([same(0), same(1), pa.array(items, pa.int64()), packed(docs[doc]), packed(score[at, doc])], names=["bundle", "shard", "item", "docs", "scores"])


def _select(k: int):
    """The last owner's part: each item's first ``k`` documents of the shard. Every document of the shard is on the right."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        items, docs, score = _add(left, right)
        ids = right.filter(pc.equal(right.column("owner"), -1)).select(["row", "doc_id"])
        ids = ids.append_column("n", pa.array(np.arange(ids.num_rows)))
        by_id = pc.sort_indices(ids, [("doc_id", "ascending"), ("row", "ascending")], null_placement="at_end")
        place, order = np.empty(ids.num_rows, np.int64), by_id.to_numpy()
        place[order] = np.arange(len(order))
        row = ids.column("row").to_numpy()
        by_row = np.argsort(row)
        of = by_row[np.searchsorted(row[by_row], docs)] if len(row) else docs  # each document's line in ids
        names, found, scores = [], [], []
        for i, line in zip(items.tolist(), score, strict=True):
            some = np.flatnonzero(line > 0)
            some = some[np.lexsort((place[of[some]], -line[some]))[:k]]
            names.append(np.full(len(some), i)), found.append(of[some]), scores.append(line[some])
        joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        at = pa.array(joined(found), pa.int64())
        return pa.table([pa.array(joined(names), pa.int64()), ids.column("doc_id").take(at), ids.column("row").take(at), pa.array(joined(scores), pa.int64())], names=["item", "doc_id", "row", "score"])

    return run


def rank_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 20, owners: int = 4) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents of the highest score above 0 for each item."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/items-{uuid.uuid4().hex}"
    _item_terms(items, item_id, item_text).write.parquet(folder)  # items are numbered once
    asked = spark.read.parquet(folder)
    found = _postings(docs, asked.select("term").distinct(), doc_id, text, owners)
    lengths = found.where("owner = -1")
    total, held = lengths.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()  # L and N
    count, many = asked.agg(F.count("*"), F.count_distinct("item")).first()
    shards, bundles = max(1, -(-held // SHARD_DOCS)), max(1, -(-count // BUNDLE_TERMS), -(-many // BUNDLE_ITEMS))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    # A row per item, term and shard with the term's weight; documents with a term are counted over all postings.
    df = found.where("owner >= 0").select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * held + 2) / (2 * F.col("df") + 1)))
    # The same hash as the postings' deals terms to their owners.
    owner = F.expr(f"cast(shiftrightunsigned(crc32(encode(term, 'UTF-8')), 7) % {owners} as int)")
    weights = asked.join(df, "term").select(F.pmod(F.xxhash64("item"), F.lit(bundles)).alias("bundle"), "item", "term", (weight * F.col("repeats")).alias("weight"), owner.alias("owner"))
    place = f"{shared_folder(spark)}/weights-{uuid.uuid4().hex}"
    weights.write.partitionBy("owner").parquet(place)
    weights = spark.read.schema("bundle long, item long, term string, weight long, owner int").parquet(place)

    m = F.lit(75) + F.expr(f"(25 * n * {held}L) div {max(1, total)}L")
    state = spark.createDataFrame([], _STATE)
    for o in range(owners):
        own = weights.where(F.col("owner") == o).select("bundle", each(shards).alias("shard"), "item", F.lit(None).cast("array<long>").alias("docs"), F.lit(None).cast("array<long>").alias("scores"), "term", "weight")
        left = state.select("*", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("weight")).unionByName(own)
        last = o == owners - 1
        right = found.where(F.col("owner").isin(o, -1) if last else F.col("owner") == o)
        right = right.select("row", shard.alias("shard"), m.alias("m"), "terms", "counts", each(bundles).alias("bundle"), *["owner", "doc_id"] * last)
        both = left.groupBy("bundle", "shard").cogroup(right.groupBy("bundle", "shard"))
        state = both.applyInArrow(_select(k), T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("row", T.LongType()), T.StructField("score", T.LongType())])) if last else both.applyInArrow(_pass_on, _STATE)
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    best = state.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")

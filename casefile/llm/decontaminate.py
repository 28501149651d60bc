"""Benchmark decontamination: find places of documents within an edit distance of a benchmark item.

Texts are compared as words (runs of letters and digits, small letters). An item of n words is found in a text if a
part of it is within ``max_edits * n`` word edits. CGK random walks embed the windows that begin at every word, and the
items: a walk reads a word per step and, by a random bit of step and word, stays on it or goes on, so that few edits
leave most steps alike: edit distance becomes Hamming distance. Samples of ``BITS`` steps are the LSH keys, so many that a
pair at the bound agrees in one with the wanted ``recall``, if a step of the two is alike with probability ``LIKE``. Windows
that agree with an item in a key, and hold enough of its words, are verified by an exact alignment. Windows with more words
or pairs of words of no item than any bound allows are not embedded. Items of more than ``LONGEST`` words are looked for by their parts: one
at least has no more than its share of the edits.

Places: of all parts of a text within the bound, that of the least distance is one (of equal ones that which ends first,
and the shortest that ends there); then, of those that don't overlap it, the next, and so on.

The benchmark is split into blocks of bounded size. They are searched one after the other, each indexed and broadcast on its own, its
places written to the shared folder and its index dropped, so driver and executors hold one block's index however large the
benchmark is; documents are read once per block and never shuffled. Walks keep a few numbers per word of a slice of the documents, whatever the items' lengths.

Defined cases: null and empty texts hold nothing, and items without words are nowhere; items of under five words match
exactly only, as the bound allows no edit; very long texts and items are compared whole; repeated documents each give
their rows; repeated items are found under each id; null ids come back as null; empty tables give no rows; other columns
are not looked at.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import shared_folder, takes_over
from .textbytes import NOT_ALNUM, U, Words, lowered, run_starts, slices

MAX_EDITS = 0.2
#: Walks, steps that make a key, the least probability of a step to be alike, words of an item or part of one.
WALKS, BITS, LIKE, LONGEST = 3, 3, 0.4, 64
#: Bytes of benchmark texts that one broadcast index is made of, about; the index of a text takes some 40 times its bytes.
BLOCK_BYTES = 1 << 20


def allowed(n: int, max_edits: float = MAX_EDITS) -> int:
    """Word edits allowed for an item of ``n`` words."""
    return int(max_edits * n + 1e-9)


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words(lowered(data), offsets, NOT_ALNUM)
    return words.hashes(), words.doc


class _Keys:
    """The LSH keys of one sample of steps of a walk: codes of the items' parts, and the codes' beginnings."""

    def __init__(self, steps: list[int], symbols: np.ndarray, parts: np.ndarray, base: int):
        self.steps, self.base = steps, base
        self.codes = []  # of each number of steps the codes there are, in order; the last with the parts of each
        code = np.zeros(len(parts), np.int64)
        for k in range(len(steps)):
            found, code = np.unique(code * base + symbols[:, k], return_inverse=True)
            self.codes.append(found)
        order = np.argsort(code, kind="stable")
        self.parts, self.begin = parts[order], np.searchsorted(code[order], np.arange(len(self.codes[-1]) + 1))
        self.first = np.zeros(base, bool)
        self.first[self.codes[0]] = True


class Index:
    """A block of items: their words, parts and keys. Words are numbered from 1; 0 is any word that no item has."""

    def __init__(self, items: list[tuple], max_edits: float, recall: float):
        texts = pa.RecordBatch.from_arrays([pa.array([t for _, t in items], pa.large_string())], ["text"])
        words: list[np.ndarray] = []
        for _, data, offsets in slices(texts, "text"):
            h, doc = _hashes(data, offsets)
            words += [h[a:b] for a, b in zip(doc[:-1], doc[1:], strict=True)]
        kept = [i for i, h in enumerate(words) if len(h)]
        self.ids, words = [items[i][0] for i in kept], [words[i] for i in kept]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, U)
        self.bloom = np.zeros(1 << (16 * len(self.vocabulary)).bit_length(), bool)
        self.bloom[(self.vocabulary & U(len(self.bloom) - 1)).astype(np.int64)] = True
        self.words = [np.searchsorted(self.vocabulary, h) + 1 for h in words]
        self.n = np.array([len(h) for h in words], np.int64)
        self.edits = np.array([allowed(k, max_edits) for k in self.n.tolist()], np.int64)
        self.end, self.base = len(self.vocabulary) + 1, len(self.vocabulary) + 2
        item, offset, size = [], [], []
        for i, n in enumerate(self.n.tolist()):
            k = -(-n // LONGEST)
            edge = [n * j // k for j in range(k + 1)]
            item += [i] * k
            offset += edge[:-1]
            size += [b - a for a, b in zip(edge[:-1], edge[1:], strict=True)]
        self.item, self.offset = np.array(item, np.int64), np.array(offset, np.int64)
        # Pairs of words of the items, as first * base + second.
        self.twos = np.unique(np.concatenate([np.array([-1])] + [w[:-1] * self.base + w[1:] for w in self.words]))
        # Each item's different words, as item * base + word.
        pairs = [np.unique(w) + i * self.base for i, w in enumerate(self.words)]
        self.pairs = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
        self._walks(np.array(size, np.int64), max_edits, recall)

    def _walks(self, size: np.ndarray, max_edits: float, recall: float) -> None:
        rng = np.random.default_rng(4)
        # Per class of lengths: its shortest, the words and the pairs of words of any item that a window of so many words
        # must hold (an edit takes one word and two pairs), and the walks.
        self.classes: list[tuple[int, int, int, list[tuple[np.ndarray, dict[int, list[tuple[_Keys, int]]]]]]] = []
        flat = np.concatenate([np.append(self.words[i][o : o + m], self.end) for i, o, m in zip(self.item.tolist(), self.offset.tolist(), size.tolist(), strict=True)]) if len(size) else np.zeros(0, np.int64)
        start = np.cumsum(size + 1) - size - 1
        many = math.ceil(math.log(1 - recall) / math.log(1 - LIKE**BITS) / WALKS)
        shortest = 1
        while shortest <= LONGEST:
            parts = np.flatnonzero((size >= shortest) & (size < 2 * shortest))
            lengths = np.unique(size[parts]).tolist()
            edits = [allowed(m, max_edits) for m in lengths]
            need = min((min(shortest, m - e) - e for m, e in zip(lengths, edits, strict=True)), default=0)
            pairs = min((min(shortest, m - e) - 1 - 2 * e for m, e in zip(lengths, edits, strict=True)), default=0)
            span, walks = 3 * shortest // 2, []
            for _ in range(WALKS if len(parts) else 0):
                goes = rng.random((span, self.base)) < 0.5
                goes[:, self.end] = False
                seen, at = np.empty((span, len(parts)), np.int32), start[parts]
                for j in range(span):
                    seen[j] = flat[at]
                    at += goes[j, flat[at]]
                keys: dict[int, list[tuple[_Keys, int]]] = {}
                for _ in range(many if max(edits) else 1):
                    sample = sorted(rng.choice(span, min(BITS, span), replace=False).tolist())
                    made = _Keys(sample, seen[sample].T.astype(np.int64), parts, self.base)
                    for k, j in enumerate(sample):
                        keys.setdefault(j, []).append((made, k))
                walks.append((goes, keys))
            if len(parts):
                self.classes.append((shortest, need, pairs, walks))
            shortest *= 2

    def candidates(self, seq: np.ndarray, starts: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the window's first word, part) of the windows of ``seq`` that agree with a part in a key. ``pair``:
        whether a pair of words of an item begins at a place."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        known = np.append(0, np.cumsum((seq > 0) & (seq < self.end)))
        twos = np.append(0, np.cumsum(pair))
        for shortest, need, pairs, walks in self.classes:
            # Words of no item are edits: a window with too many of them is within no part's bound.
            some = starts[known[np.minimum(starts + shortest, len(seq))] - known[starts] >= need]
            some = some[twos[np.minimum(some + shortest - 1, len(seq))] - twos[some] >= pairs]
            for goes, keys in walks:
                found += self._walk(seq, some, goes, keys)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _walk(self, seq: np.ndarray, starts: np.ndarray, goes: np.ndarray, keys: dict[int, list[tuple[_Keys, int]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at, open_ = starts.copy(), {}
        for j in range(max(keys) + 1 if len(starts) else 0):
            symbol = seq[at]
            for made, k in keys.get(j, []):
                if k == 0:
                    rows = np.flatnonzero(made.first[symbol])
                    code = np.zeros(len(rows), np.int64)
                else:
                    rows, code = open_.pop(id(made))
                value = code * made.base + symbol[rows]
                known = made.codes[k]
                place = np.minimum(np.searchsorted(known, value), len(known) - 1)
                hit = known[place] == value
                rows, code = rows[hit], place[hit]
                if k < len(made.steps) - 1:
                    open_[id(made)] = rows, code
                elif len(rows):
                    count = made.begin[code + 1] - made.begin[code]
                    each = np.repeat(np.arange(len(rows)), count)
                    nth = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                    yield starts[rows[each]], made.parts[made.begin[code[each]] + nth]
            at += goes[j][symbol]

    def places(self, h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, distance, from word, to word) of every place found in rows of word hashes."""
        if not len(h) or not self.ids:
            return
        some = np.flatnonzero(self.bloom[(h & U(len(self.bloom) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[some]), len(self.vocabulary) - 1)
        word = np.zeros(len(h), np.int64)
        word[some] = np.where(self.vocabulary[at] == h[some], at + 1, 0)
        row = np.repeat(np.arange(len(doc) - 1), np.diff(doc))
        starts = np.arange(len(h)) + row  # each row ends with a mark
        seq = np.full(len(h) + len(doc) - 1, self.end, np.int32)
        seq[starts] = word
        pair = np.zeros(len(seq), bool)
        at, _ = run_starts(doc, 2)
        at = at[(word[at] > 0) & (word[at + 1] > 0)]
        value = word[at] * self.base + word[at + 1]
        pair[starts[at]] = self.twos[np.minimum(np.searchsorted(self.twos, value), len(self.twos) - 1)] == value
        place, part = self.candidates(seq, starts, pair)
        item = self.item[part]
        own = np.searchsorted(starts, place)  # the window's first word among all words
        low = np.maximum(own - self.offset[part] - self.edits[item], doc[row[own]])
        high = np.minimum(own - self.offset[part] + self.n[item] + 2 * self.edits[item], doc[row[own] + 1])
        some = np.unique(np.stack([row[own], item, low, high], 1), axis=0) if len(own) else np.zeros((0, 4), np.int64)
        r, i, low, high = some.T
        # Enough of the item's words must stand there.
        size = np.maximum(high - low, 0)
        enough = np.zeros(len(i), np.int64)
        for lo in range(0, len(i), 4096):
            s, of = size[lo : lo + 4096], np.repeat(np.arange(lo, min(lo + 4096, len(i))), size[lo : lo + 4096])
            value = i[of] * self.base + word[np.arange(len(of)) - np.repeat(np.cumsum(s) - s, s) + low[of]]
            in_ = self.pairs[np.minimum(np.searchsorted(self.pairs, value), len(self.pairs) - 1)] == value
            enough[lo : lo + 4096] = np.bincount(of - lo, in_, minlength=len(s))
        fits = enough >= self.n[i] - self.edits[i]
        r, i, low, high = r[fits], i[fits], low[fits], high[fits]
        k = 0
        while k < len(r):
            end, last = int(high[k]), k + 1
            while last < len(r) and r[last] == r[k] and i[last] == i[k] and low[last] <= end:
                end, last = max(end, int(high[last])), last + 1
            for distance, a, b in _aligned(self.words[i[k]], word[low[k] : end], int(self.edits[i[k]])):
                yield int(r[k]), int(i[k]), distance, int(low[k] - doc[r[k]]) + a, int(low[k] - doc[r[k]]) + b
            k = last


def align(item: np.ndarray, text: np.ndarray, anchored: bool = False) -> np.ndarray:
    """Edit distance of ``item`` to the best part of ``text`` that ends at each place (from its start, if anchored)."""
    steps = np.arange(len(text) + 1)
    row = steps.copy() if anchored else np.zeros(len(text) + 1, np.int64)
    for i, x in enumerate(item, 1):
        new = np.concatenate([[i], np.minimum(row[:-1] + (text != x), row[1:] + 1)])
        row = np.minimum.accumulate(new - steps) + steps
    return row


def _aligned(item: np.ndarray, text: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """(distance, from, to) of the places of ``item`` in ``text``."""
    ends = align(item, text)
    used = np.zeros(len(text) + 1, bool)
    near = np.flatnonzero(ends <= most)
    for end in near[np.argsort(ends[near], kind="stable")].tolist():
        if end and not used[end - 1]:
            back = align(item[::-1], text[max(0, end - len(item) - most) : end][::-1], anchored=True)
            start = end - int(back.argmin())
            if start < end and not used[start:end].any():
                used[start:end] = True
                yield int(ends[end]), start, end


def find_items(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_edits: float = MAX_EDITS, recall: float = 0.999, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(id, item_id, distance, n_words, from_word, to_word)``: every place of a document that holds an item."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField(id, docs.schema[id].dataType), T.StructField(item_id, benchmark.schema[item_id].dataType), *[T.StructField(c, T.LongType()) for c in ("distance", "n_words", "from_word", "to_word")]])
    item_kind = to_arrow_type(benchmark.schema[item_id].dataType)

    def searched(block: int) -> tuple[DataFrame, Broadcast]:
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(Index([(r["i"], r["t"]) for r in part.collect()], max_edits, recall))  # of about block_bytes of texts

        def run(batches):
            takes_over("decontaminate")
            index = shared.value
            for batch in batches:
                for got, data, offsets in slices(batch, "text"):
                    found = [(r, index.ids[i], distance, int(index.n[i]), lo, hi) for r, i, distance, lo, hi in index.places(*_hashes(data, offsets))]
                    if found:
                        cols = list(zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays([got.column("id").take(pa.array(cols[0])), pa.array(cols[1], item_kind), *[pa.array(c, pa.int64()) for c in cols[2:]]], names=schema.names)

        return rows.mapInArrow(run, schema), shared

    if blocks == 1:
        return searched(0)[0]
    folder = f"{shared_folder(spark)}/items-{uuid.uuid4().hex}"
    for block in range(blocks):
        found, index = searched(block)
        found.write.mode("append").parquet(folder)
        index.destroy()
    return spark.read.schema(schema).parquet(folder)

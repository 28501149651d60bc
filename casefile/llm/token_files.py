"""Token ids in Parquet files: a list column of ids beside the documents' metadata, in order of their ids.

Spark's writer makes the files: version-2 pages, so that ids are dictionary or delta encoded; row groups and pages of
set sizes, so that readers can plan; column and offset indexes, so that a read of some documents or of the metadata
alone touches only their pages. Documents are dealt by ranges of their ids, so file order is document order.

In a text with single spaces or line breaks between words every space or line break begins or ends a pre-token, and so
does a comma or full stop after a letter at a word's end. Such parts are encoded on their own: a worker looks up a slice's
different parts in a table of bounded size (64-bit hashes, ids in one array), and the ``tokenizers`` library encodes those
that are new: letters, a pre-token each, by its model, ASCII punctuation after them, another, out of those met before, all
other parts in one call, a line each. All other texts go to the library whole.

Defined cases: null text counts as empty: the end id alone; null ids come first; rows that share an id follow each
other in the order of their texts' hashes, repeated rows in one file; a very long text is a slice of its own; an empty
table gives no files' rows; columns named in ``metadata`` are written beside the ids, whatever their names, others not.
"""

from __future__ import annotations

import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bpe import byte_symbols
from .shared import cut, fresh
from .textbytes import SPACE, U, Words, slices

#: Bytes of texts whose different words are looked up together.
SLICE_BYTES = 3 << 20
END_ID, CACHE, MARKS_KEPT = 2, 1_000_000, 10_000
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2_000
#: ASCII punctuation but for the apostrophe, of which a run after letters is a pre-token; control characters
#: and white space but for the space and the line break, as bytes; white space beyond ASCII, as UTF-8.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_OTHER_BYTES = np.isin(np.arange(256), [1, 9, 11, 12, 13, 28, 29, 30, 31])
_WIDE_SPACE = {"\x85\xa0": 2, "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000": 3}


def _irregular(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """Rows whose spaces and line breaks do not all stand alone between words, or that hold other white space, the mark
    used below or what may be a special token. Empty rows are irregular too."""
    count = lambda at: np.diff(np.searchsorted(np.flatnonzero(at), offsets))
    odd = _OTHER_BYTES[data]
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    for chars, n in _WIDE_SPACE.items():
        fit = lead[lead + n <= len(data)]
        code = sum(data[fit + k].astype(np.int64) << 8 * (n - 1 - k) for k in range(n))
        odd[fit[np.isin(code, [int.from_bytes(c.encode(), "big") for c in chars])]] = True
    return (np.diff(words.doc) != count((data == 32) | (data == 10)) + 1) | (count(odd) > 0)


_open: dict = {}
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


class _Table:
    """Ids of text parts by the parts' hashes; those not asked for lately go when there are more than ``CACHE``."""

    def __init__(self):
        self.key, self.start, self.size, self.used, self.ids, self.time = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, "<i4"), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of ascending ``keys``, -1 for those that are new."""
        at = np.searchsorted(self.key, keys)
        known = at < len(self.key)
        known[known] = self.key[at[known]] == keys[known]
        self.time += 1
        self.used[at[known]] = self.time
        return np.where(known, at, -1)

    def add(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        if len(self.key) > CACHE:
            self._keep(self.used > np.median(self.used))
        at = np.searchsorted(self.key, keys)
        start = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, ids])
        self.key, self.start, self.size, self.used = np.insert(self.key, at, keys), np.insert(self.start, at, start), np.insert(self.size, at, size), np.insert(self.used, at, self.time)

    def _keep(self, some: np.ndarray) -> None:
        self.key, self.size, self.used = self.key[some], self.size[some], self.used[some]
        self.ids, self.start = self.ids[_spread(self.start[some], self.size)], np.cumsum(self.size) - self.size


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of every run of ``size``, one run after the other."""
    total = np.cumsum(size)
    # A slice or a table has less than 2**31 ids.
    return np.arange(total[-1] if len(total) else 0, dtype=np.int32) + np.repeat((start - total + size).astype(np.int32), size)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values in order, the first place of each, and each value's number among them; only different values are sorted."""
    coded = pa.array(values).dictionary_encode()
    found, code = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    # Codes come in order of first places.
    first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))
    order = np.argsort(found)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return found[order], first[order], number[code]


class _Encoder:
    """The tokenizer of a file, and the ids of texts as little-endian 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.table = _Table()
        #: Ids of a line break, a comma and a full stop on their own.
        self.alone = np.array([self.whole(c)[0] for c in "\n,."], "<i4")
        self.symbols = byte_symbols()
        #: Ids of punctuation after letters.
        self.marks: dict = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<i4")

    def parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of the parts, and the ids."""
        size, own, others, merged = [0] * len(parts), [], [], self.tok.model.tokenize
        for i, text in enumerate(b"\n".join(parts).decode().split("\n")):
            letters = text.rstrip(_MARKS)
            spaced = letters[:1] == " "
            if (letters[1:] if spaced else letters).isalpha():
                marks = text[len(letters) :]
                # The symbol of a small or capital letter is itself.
                symbols = (self.symbols[32] + letters[1:] if spaced else letters) if letters.isascii() else "".join([self.symbols[b] for b in letters.encode()])
                ids = [t.id for t in merged(symbols)]
                if marks:
                    if marks not in self.marks:
                        if len(self.marks) >= MARKS_KEPT:
                            self.marks.clear()
                        self.marks[marks] = self.whole(marks).tolist()
                    ids += self.marks[marks]
                size[i] = len(ids)
                own += ids  # one list, as many small ones keep the garbage collector busy
            else:
                others.append((i, text))
        # A line break is a pre-token of its own and in no part.
        ids = self.whole("\n".join([t for _, t in others]))
        breaks = np.flatnonzero(ids == self.alone[0])
        at, size = [i for i, _ in others], np.array(size, np.int64)
        size[at] = np.diff(np.concatenate([[-1], breaks, [len(ids)]]))[: len(at)] - 1
        whose = np.zeros(len(parts), bool)
        whose[at] = True
        whose, out = np.repeat(whose, size), np.empty(size.sum(), "<i4")
        out[~whose], out[whose] = own, np.delete(ids, breaks)
        return size, out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of every text of a slice."""
        bounds, raw = offsets.tolist(), data.tobytes()
        out: list = [None] * (len(bounds) - 1)
        words = Words(data, offsets, SPACE)
        regular = ~_irregular(data, offsets, words)
        for i in np.flatnonzero(~regular).tolist():
            out[i] = self.whole(raw[bounds[i] : bounds[i + 1]].decode())
        use = np.flatnonzero(np.repeat(regular, np.diff(words.doc)))
        if not len(use):
            return out
        row = np.repeat(np.arange(len(out)), np.diff(words.doc))[use]
        start, last = words.start[use], data[words.end[use] - 1]
        marked = ((last == 44) | (last == 46)) & (words.end[use] - start > 1)
        marked &= _LETTER[data[np.maximum(words.end[use] - 2, 0)]]
        words.end[use] -= marked
        end = words.end[use]
        spaced = (start > offsets[row]) & (data[np.maximum(start - 1, 0)] == 32)
        key, first, which = _distinct(words.hashes()[use] ^ np.where(spaced, U(0x5851F42D4C957F2D), U(0)))
        new = np.flatnonzero(self.table.find(key) < 0)
        if len(new):
            at = first[new]
            self.table.add(key[new], *self.parts([raw[a:b] for a, b in zip((start[at] - spaced[at]).tolist(), end[at].tolist(), strict=True)]))
        place = self.table.find(key)[which]
        # The ids of a line break, a comma and a full stop stand after those of the table.
        ids = np.concatenate([self.table.ids, self.alone])
        breaks = np.flatnonzero(data == 10)
        of = np.searchsorted(offsets, breaks, "right") - 1
        breaks, of = breaks[regular[of]], of[regular[of]]
        before = np.searchsorted(breaks, start)
        marks = np.cumsum(marked)
        at = np.arange(len(start)) + marks - marked + before
        n = len(start) + int(marks[-1]) + len(breaks)
        begin, size, owner = np.full(n, len(ids) - 3, np.int64), np.ones(n, np.int64), np.empty(n, np.int64)
        begin[at], size[at], owner[at] = self.table.start[place], self.table.size[place], row
        begin[at[marked] + 1], owner[at[marked] + 1] = len(ids) - 2 + (last[marked] == 46), row[marked]
        words_before = np.searchsorted(start, breaks)
        owner[np.arange(len(breaks)) + words_before + np.append(0, marks)[words_before]] = of
        flat = ids[_spread(begin, size)]
        ends = np.append(0, np.cumsum(size))[np.searchsorted(owner, np.arange(len(out) + 1))]
        for i in np.flatnonzero(regular).tolist():
            out[i] = flat[ends[i] : ends[i + 1]]
        return out


def write_tokens(docs: DataFrame, folder: str, path: str, id: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = (), end_id: int = END_ID) -> None:
    """Encode every text, append ``end_id`` and write ``(id, n_tokens, tokens, *metadata)`` in order of the ids."""
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.col(c).alias(f"m{i}") for i, c in enumerate(metadata)])
    rows = rows.repartitionByRange(F.asc("id"), F.asc(F.xxhash64("text"))).sortWithinPartitions("id", F.xxhash64("text"))
    kept = [f"m{i}" for i in range(len(metadata))]
    schema = T.StructType([rows.schema["id"], T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType(), False)), *[rows.schema[c] for c in kept]])

    def run(batches):
        if path not in _open:
            _open[path] = _Encoder(path)
        for batch in batches:
            for part, data, offsets in slices(batch, "text", SLICE_BYTES):
                ids = [np.append(x, np.int32(end_id)).astype(np.int32) for x in _open[path].encode(data, offsets)]
                n = np.array([len(x) for x in ids])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), lists, *[part.column(c) for c in kept]], names=schema.names)

    named = rows.mapInArrow(run, schema).toDF(id, "n_tokens", "tokens", *metadata)
    options = {"parquet.writer.version": "v2", "compression": "zstd", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS}
    named.write.options(**options).parquet(folder)


def read_tokens(spark: SparkSession, folder: str, ids: list | None = None, columns: tuple[str, ...] | None = None, id: str = "doc_id") -> DataFrame:
    """The documents of a folder of token files, with ``file`` and ``row``, their place in order.

    ``ids``: those documents alone; row groups and pages that hold none of them are not read. ``columns``: those alone."""
    files = spark.read.parquet(folder)
    some = files if ids is None else files.where(F.col(f"`{id}`").isin(list(ids)))
    place = [F.col("_metadata.file_name").alias(fresh(files, "file")), F.col("_metadata.row_index").alias(fresh(files, "row"))]
    return some.select(*[F.col(f"`{c}`") for c in columns or files.columns], *place)


def token_offsets(tokens: DataFrame, id: str = "doc_id") -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` per document of ``read_tokens``: ids before it, its ids, their crc32."""
    schema = T.StructType([T.StructField("id", tokens.schema[id].dataType), T.StructField("file", T.StringType()), T.StructField("row", T.LongType()), T.StructField("n", T.LongType()), T.StructField("crc", T.LongType())])

    def run(batches):
        for batch in batches:
            lists = batch.column("tokens")
            values, offsets = lists.values.to_numpy().astype("<i4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in itertools.pairwise(offsets.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("file"), batch.column("row"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=schema.names)

    each = cut(tokens.select(F.col(id).alias("id"), "tokens", "file", "row").mapInArrow(run, schema))
    # A row per file is summed up in one task; documents are summed up file by file.
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")  # more digits come later, whatever the text order
    files = each.groupBy("file").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("file", before.alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = each.withColumn("inside", inside).join(files, "file")
    return out.select(F.col("id").alias(id), (F.col("base") + F.col("inside")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))

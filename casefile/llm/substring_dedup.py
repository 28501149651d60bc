"""Substring dedup: words inside a passage of ``window`` words that also starts anywhere else are removed.

Repeated-phrase automata. Documents are dealt into shards of bounded size, whose texts are shuffled once:

1. Every window of 35 words is represented by the six-word phrase in it of the least hash, so equal windows have equal
   phrases. Phrases that occur twice, anywhere, recur.
2. Windows whose phrase recurs are counted by a hash of 96 bits; those that occur twice are likely passages. Each shard that
   holds one names another shard that does, the one before it in a ring of them (or itself, if the window occurs there alone, more than once).
3. The shard that is named sends the passage: its words, windows that follow each other in one piece.
4. A shard compiles the phrases of the passages that it was sent into an Aho-Corasick automaton and streams its documents
   through it. The automaton finds every place where a passage may stand; around each, the document is compared with the
   passage character by character as far as they are equal, and stretches of 35 equal words or more are removed.

Hashes only decide which passages travel: what is removed has been found by the automaton and equals, word by word, a
text that stands elsewhere. No text is compared with its own place.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``, unchanged; null and empty texts have none; texts shorter than a
window lose nothing; occurrences that overlap each other count; a repeated row repeats its windows, so both rows lose
them (rows of equal id and text are one text with a number of copies); ids may be null or repeated, each row gives a row;
a very long text is a shard of its own; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .textbytes import SPACE, Grams, U, Words, mix, run_starts, slices, sliding_min

WINDOW, PHRASE = 35, 6
#: Text bytes of a shard, on average.
SHARD_BYTES = 2 << 20
_OTHER = U(0x6A09E667F3BCC909)


def _windows(words: Words, window: int, phrase: int):
    """Place, row and phrase hash of every window, the phrase hash of every word place, and the words' hashes."""
    h = words.hashes()
    at, row = run_starts(words.doc, window)
    if not len(at):
        return at, row, np.zeros(0, U), np.zeros(0, U), h
    run = Grams(h).at(np.arange(len(h) - phrase + 1), phrase)
    return at, row, sliding_min(run, window - phrase + 1)[at], run, h


def _chosen(at: np.ndarray, least: np.ndarray, run: np.ndarray, span: int) -> np.ndarray:
    """The first place, in each of the windows ``at``, of the phrase that is the window's least; each place once."""
    padded = np.full(len(run) + span - 1, U(0xFFFFFFFFFFFFFFFF))
    padded[at + span - 1] = ~least
    place = np.flatnonzero(~sliding_min(padded, span) == run)
    values, rank = np.unique(run[place], return_inverse=True)
    key = np.sort(rank * len(run) + place)
    wanted = np.searchsorted(values, least) * len(run) + at
    return np.unique(key[np.searchsorted(key, wanted)] % len(run))


def _passages(h: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows, of 64 and 32 bits."""
    other = Grams(mix(h ^ _OTHER)).at(at, window) >> U(32)
    return Grams(h).at(at, window).view(np.int64), other.astype(np.uint32).view(np.int32)


def _grouped(p1: np.ndarray, p2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal pairs follow each other, and where in it each pair begins."""
    order = np.argsort(p1, kind="stable")
    if ((np.diff(p1[order]) == 0) & (np.diff(p2[order]) != 0)).any():
        order = np.lexsort((p2, p1))
    new = (np.diff(p1[order]) != 0) | (np.diff(p2[order]) != 0)
    return order, np.flatnonzero(np.append(True, new)) if len(order) else np.zeros(0, np.int64)


def _found(k1: np.ndarray, k2: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """Places of pairs in known pairs in order, -1 for those that are not there."""
    out, at = np.full(len(p1), -1), np.searchsorted(k1, p1)
    while True:
        same = at < len(k1)
        same[same] = k1[at[same]] == p1[same]
        hit = same.copy()
        hit[same] = k2[at[same]] == p2[same]
        out[hit] = at[hit]
        if not (same & ~hit & (out < 0)).any():
            return out
        at = np.where(same & ~hit, at + 1, len(k1))


def _counted(values: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values, and the sum of each one's weights."""
    found, of = np.unique(values, return_inverse=True)
    return found, np.bincount(of.ravel(), weight, minlength=len(found)).astype(np.int64)


def _member(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _texts(table: pa.Table, column: str = "text"):
    for batch in table.combine_chunks().to_batches():
        yield from slices(batch, column)


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(id, n_words, n_removed, kept, spans)`` per row: ``kept`` the kept words joined by a space, ``spans`` the
    removed runs of words as (from_word, to_word)."""
    span = window - phrase + 1
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    names = rows.groupBy("id", F.xxhash64("text").alias("a"), F.crc32("text").alias("b")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("size"))
    size, most = names.agg(F.sum("size"), F.max("n")).first()
    rows = rows.groupBy("id", "text").agg(F.count("*").alias("copies")) if (most or 0) > 1 else rows.withColumn("copies", F.lit(1).cast("long"))
    rows = rows.withColumn("name", F.xxhash64("id", "text"))
    rows = rows.withColumn("shard", F.pmod("name", F.lit(max(1, -(-(size or 0) // shard_bytes)))).cast("int"))
    dealt = rows.groupBy("shard")

    def phrases(left: pa.Table) -> pa.Table:
        shard, values, weight = left.column("shard")[0].as_py(), [np.zeros(0, U)], [np.zeros(0)]
        for part, data, offsets in _texts(left):
            words = Words(data, offsets, SPACE)
            at, _, least, run, _ = _windows(words, window, phrase)
            if len(at):
                place = _chosen(at, least, run, span)
                values.append(run[place])
                weight.append(part.column("copies").to_numpy()[np.searchsorted(words.doc, place, "right") - 1])
        found, n = _counted(np.concatenate(values), np.concatenate(weight))
        return pa.table([pa.array(found.view(np.int64)), pa.array(np.full(len(found), shard, np.int32)), pa.array(n)], names=["phrase", "shard", "n"])

    found = dealt.applyInArrow(phrases, "phrase long, shard int, n long")
    total = F.sum("n").over(Window.partitionBy("phrase"))  # a row per shard at most
    recurring = found.withColumn("n", total).where("n > 1").select("phrase", "shard")

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        p1, p2, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        known = np.sort(right.column("phrase").to_numpy().view(U)) if right.num_rows else np.zeros(0, U)
        for part, data, offsets in _texts(left) if len(known) else ():
            at, row, least, _, h = _windows(Words(data, offsets, SPACE), window, phrase)
            some = _member(known, least)
            for kept, new in zip((p1, p2, weight), (*_passages(h, at[some], window), part.column("copies").to_numpy()[row[some]]), strict=True):
                kept.append(new)
        p1, p2, weight = np.concatenate(p1), np.concatenate(p2), np.concatenate(weight)
        order, new = _grouped(p1, p2)
        n = np.add.reduceat(weight[order], new) if len(new) else weight
        shard = left.column("shard")[0].as_py() if left.num_rows else 0
        return pa.table([pa.array(p1[order[new]]), pa.array(p2[order[new]]), pa.array(np.full(len(new), shard, np.int32)), pa.array(n)], names=["p1", "p2", "shard", "n"])

    found = dealt.cogroup(recurring.groupBy("shard")).applyInArrow(windows, "p1 long, p2 int, shard int, n long")
    all_ = Window.partitionBy("p1", "p2")  # a row per shard at most
    # The shards of a passage stand in a ring: each asks the one before it, so that none answers for all.
    before = F.coalesce(F.lag("shard").over(all_.orderBy("shard")), F.max("shard").over(all_))
    found = found.select("p1", "p2", "shard", F.sum("n").over(all_).alias("n"), before.alias("before")).where("n > 1")
    asked = found.select(F.col("before").alias("shard"), F.col("shard").alias("target"), "p1", "p2")

    def pieces(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            p1, p2 = right.column("p1").to_numpy(), right.column("p2").to_numpy()
            order, first = _grouped(p1, p2)
            k1, k2, target = p1[order[first]], p2[order[first]], right.column("target").to_numpy()[order]
            own, number = left.column("shard")[0].as_py(), np.diff(np.append(first, len(order)))
            seen = np.zeros(len(k1), np.int64)
            for part, data, offsets in _texts(left):
                words = Words(data, offsets, SPACE)
                at, row, _, _, h = _windows(words, window, phrase)
                if not len(at):
                    continue
                which = _found(k1, k2, *_passages(h, at, window))
                some = np.flatnonzero(which >= 0)
                at, row, which = at[some], row[some], which[some]
                # The first place of each passage goes to all who asked, the second to its own shard too.
                order = np.argsort(which, kind="stable")
                new = np.append(True, which[order][1:] != which[order][:-1]) if len(order) else np.zeros(0, bool)
                begin = np.flatnonzero(new)
                count = np.diff(np.append(begin, len(order)))
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order)) - np.repeat(begin, count) + seen[which[order]]
                np.add.at(seen, which, 1)
                use = np.flatnonzero(place < 2)
                at, row, which, place = at[use], row[use], which[use], place[use]
                each = np.repeat(np.arange(len(at)), number[which])
                goes = target[np.arange(len(each)) - np.repeat(np.cumsum(number[which]) - number[which], number[which]) + first[which][each]]
                keep = (place[each] == 0) | (goes == own)
                each, goes = each[keep], goes[keep]
                order = np.lexsort((at[each], goes))
                at, row, goes = at[each][order], row[each][order], goes[order]
                if not len(at):
                    continue
                cut = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(row) != 0) | (np.diff(goes) != 0)))
                last = np.append(cut[1:], len(at)) - 1
                name = part.column("name").to_numpy()
                raw = data.tobytes()
                for a, b in zip(cut.tolist(), last.tolist(), strict=True):
                    out[0].append(int(goes[a]))
                    out[1].append(int(name[row[a]]))
                    out[2].append(int(at[a] - words.doc[row[a]]))
                    out[3].append(b" ".join(raw[words.start[at[a]] : words.end[at[b] + window - 1]].split()).decode())
        return pa.table([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["shard", "name", "from_word", "piece"])

    sent = dealt.cogroup(asked.groupBy("shard")).applyInArrow(pieces, "shard int, name long, from_word long, piece string")
    spans = T.ArrayType(T.StructType([T.StructField("from_word", T.LongType()), T.StructField("to_word", T.LongType())]))
    schema = T.StructType([T.StructField(id, docs.schema[id].dataType), T.StructField("copies", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("spans", spans)])
    kind = pa.list_(pa.struct([("from_word", pa.int64()), ("to_word", pa.int64())]))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        known = _Pieces(right, window, phrase) if right.num_rows else None
        left = left.combine_chunks()
        out: list[list] = [[], [], [], []]
        for part, data, offsets in _texts(left):
            raw = data.tobytes()
            for lo, hi, copies, name in zip(offsets[:-1].tolist(), offsets[1:].tolist(), part.column("copies").to_pylist(), part.column("name").to_pylist(), strict=True):
                words = raw[lo:hi].split()
                gone = np.zeros(len(words), bool)
                if len(words) >= window and copies > 1:
                    gone[:] = True
                elif len(words) >= window and known:
                    known.mark(b" ".join(words).decode(), name, gone)
                out[0].append(len(words))
                out[1].append(int(gone.sum()))
                if not out[1][-1]:
                    out[2].append(b" ".join(words).decode())
                    out[3].append([])
                else:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    out[2].append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode())
                    out[3].append([{"from_word": x, "to_word": y} for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
        return pa.table([left.column("id"), left.column("copies"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], kind)], names=schema.names)

    done = dealt.cogroup(sent.groupBy("shard")).applyInArrow(remove, schema)
    if (most or 0) > 1:
        done = done.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return done.drop("copies")


class _Pieces:
    """The passages that a shard was sent, and the automaton of their phrases."""

    def __init__(self, sent: pa.Table, window: int, phrase: int):
        self.window, self.phrase = window, phrase
        self.name, self.begin = sent.column("name").to_pylist(), sent.column("from_word").to_pylist()
        self.text = [f" {t} " for t in sent.column("piece").to_pylist()]
        self.units = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in self.text]
        self.automaton, piece = ahocorasick.Automaton(), 0
        for part, data, offsets in _texts(sent, "piece"):
            words = Words(data, offsets, SPACE)
            at, _, least, run, _ = _windows(words, window, phrase)
            place = _chosen(at, least, run, window - phrase + 1)
            row = np.searchsorted(words.doc, place, "right") - 1
            last = -1
            for p, r in zip((place - words.doc[row]).tolist(), (row + piece).tolist(), strict=True):
                if r != last:
                    space, last = np.flatnonzero(self.units[r] == 32), r
                lo, hi = int(space[p]), int(space[p + phrase]) + 1
                pattern = self.text[r][lo:hi]
                if pattern in self.automaton:
                    self.automaton.get(pattern)[1].append((r, lo))
                else:
                    self.automaton.add_word(pattern, (hi - lo, [(r, lo)]))
            piece += part.num_rows
        self.automaton.make_automaton()

    def mark(self, text: str, name: int, gone: np.ndarray) -> None:
        """Set ``gone`` for the words of ``text`` that lie in ``window`` words or more of a passage.

        Around every place of a phrase, text and passage are compared as far as they are equal. Where all words of the windows that hold
        the place are gone already, there is nothing left to find, so that repetitive texts take no longer than others."""
        text, units, space = f" {text} ", None, None
        for end, (size, places) in self.automaton.iter(text):
            if units is None:
                units = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                space = np.flatnonzero(units == 32)  # word i stands between spaces i and i + 1
            at = end + 1 - size
            word = int(np.searchsorted(space, at))
            low, high = max(0, word + self.phrase - self.window), min(len(gone), word + self.window)
            for r, lo in places:
                if gone[low:high].all():
                    break
                shift = at - lo
                if self.name[r] == name and space[self.begin[r]] == shift:
                    continue
                own = self.units[r]
                a = at - _equal(units[:at][::-1], own[:lo][::-1])
                b = at + size + _equal(units[at + size :], own[lo + size :])
                # Equal from a to b: the words between the first and the last space there.
                i, j = int(np.searchsorted(space, a)), int(np.searchsorted(space, b)) - 1
                if j - i >= self.window:
                    gone[i:j] = True


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many units two arrays begin with alike; they are compared in blocks that double."""
    n, at, block = min(len(a), len(b)), 0, 256
    while at < n:
        unlike = a[at : min(n, at + block)] != b[at : min(n, at + block)]
        if unlike.any():
            return at + int(unlike.argmax())
        at, block = at + block, 2 * block
    return n

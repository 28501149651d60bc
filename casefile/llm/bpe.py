"""BPE encoding and decoding as streaming transducers of bounded memory.

The encoder reads a text in parts: it normalizes and splits what can no longer change, and merges words. A word longer
than a window is merged window by window: the merge list has a sufficient lookahead, a number of symbols such that a
token that ends so far from the window's end stays whatever follows; such tokens are emitted and the window moves on.
Words' tokens are kept in a cache of bounded size. The decoder turns ids into bytes and bytes into text with a state
machine that holds back an unfinished character. A worker keeps its tokenizer, and so the cache, for later tasks until
one of another operator begins there; two generations of the cache forget the words that do not come again.

The tokenizer is a file of the ``tokenizers`` library of the word-end kind: NFC, runs of white space to a space, small
letters, words by pattern, byte symbols, merges, a suffix on a word's last symbol, and special tokens that are cut out
of the raw text first.

Defined cases: null counts as empty, which gives no ids and an empty text; repeated rows give equal results; other
columns are carried through untouched.
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import fresh, kept

_SPACE = r"\t-\r \x85\xa0  -     　"
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_RUN = regex.compile(rf"[{_SPACE}]+")
#: Characters read at a time, symbols of a long word merged at a time, words of each of the cache's two generations.
PART, WINDOW, CACHE = 1 << 16, 512, 200_000
NONE = 1 << 30


def byte_symbols() -> dict[int, str]:
    """The printable symbol of each byte: itself where printable, else the next free character from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def lookahead(merges: list[tuple[str, str]], suffix: str) -> int:
    """Symbols after a token's end that suffice to know that it stays.

    A token (a, b) can fail to form only if b is first merged with what follows it, by an earlier merge (b, z), or if b
    itself fails to form, or z fails; walking the merges in order gives each token's reach.
    """
    size = lambda t: len(t[: -len(suffix)] if suffix and t.endswith(suffix) else t)
    reach: dict[str, int] = {}
    after: dict[str, int] = {}
    for a, b in merges:
        token = a + b
        reach[token] = max(reach.get(token, 0), reach.get(b, 0), after.get(b, 0))
        after[a] = max(after.get(a, 0), size(b) + max(reach.get(b, 0), after.get(b, 0)))
    return max([1, *reach.values(), *(v + 1 for v in after.values())])


class Tokenizer:
    """What a tokenizer file says, ready to merge; made once in every Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.hold = max(map(len, self.special), default=1) - 1
        self.symbols = byte_symbols()
        self.lookahead = lookahead(merges, self.suffix)
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names[i].encode() for i in range(len(names))]
        back = {c: b for b, c in self.symbols.items()}
        special = set(self.special.values())
        strip = lambda t: t[: -len(self.suffix)] if self.suffix and t.endswith(self.suffix) else t
        self.bytes = [names[i].encode() if i in special else bytes(back[c] for c in strip(names[i])) + (b" " if self.suffix and names[i].endswith(self.suffix) else b"") for i in range(len(names))]
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """All merges of a sequence of symbols, the least rank first, leftmost first."""
        n = len(symbols)
        if n < 2:
            return symbols
        rank, symbols = self.rank, list(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j < 0 or rank.get((symbols[i], symbols[j])) != r:
                continue
            symbols[i], symbols[j], k = symbols[i] + symbols[j], None, after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [s for s in symbols if s is not None]

    def stable(self, word: str, final: bool) -> tuple[list[int], int]:
        """Ids of a word's tokens that stay whatever follows, and the characters of the word that they cover.

        If ``final``, the word ends here and all of it is covered."""
        raw = word.encode()
        symbols = [self.symbols[b] for b in raw]
        if final and symbols:
            symbols[-1] += self.suffix
        at, out, size = 0, [], WINDOW + self.lookahead
        while at < len(symbols):
            last = at + size >= len(symbols)
            if last and not final:
                break
            tokens, sure = self.merge(symbols[at : at + size]), len(symbols) if last else at + size - self.lookahead
            for t in tokens:
                n = len(t) - (len(self.suffix) if last and final and self.suffix and t.endswith(self.suffix) and at + len(t) > len(symbols) else 0)
                if at + n > sure:
                    break
                out.append(self.vocab[t])
                at += n
        if final:
            return out, len(word)
        # A character's bytes can lie in two tokens: what is kept begins with a whole character.
        while at and at < len(raw) and raw[at] & 0xC0 == 0x80:
            at -= len(self.names[out.pop()].decode())
        return out, len(raw[:at].decode())

    def ids(self, text: str) -> list[int]:
        """Ids of normalized text that ends with a word's end."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split, but not to the pattern
            return list(chain.from_iterable(map(self._word, _WORDS.findall(text))))
        get = self.cache.get
        return list(chain.from_iterable([get(c) or self._chunk(c) for c in text.split()]))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a part between white space, which is one word or several."""
        ids = self.older.get(chunk)
        if ids is None:
            ids = tuple(chain.from_iterable(map(self._word, _WORDS.findall(chunk))))
        if len(chunk) <= 64:
            if len(self.cache) >= CACHE:
                self.older, self.cache = self.cache, {}
            self.cache[chunk] = ids
        return ids

    def _word(self, word: str) -> tuple[int, ...] | list[int]:
        if len(word) > 40:
            return self.stable(word, True)[0]
        symbols, get = list(word) if word.isascii() and word.isprintable() else [self.symbols[b] for b in word.encode()], self.rank.get
        symbols[-1] += self.suffix
        ranks = [get(pair, NONE) for pair in zip(symbols, symbols[1:])]  # noqa: B905
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            symbols[i] += symbols.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), NONE)
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), NONE)
        return [self.vocab[s] for s in symbols]


def _safe_cut(text: str) -> int:
    """The last place before which nothing changes by what follows in normalization: before a base letter or ASCII."""
    for i in range(len(text) - 1, 0, -1):
        c = text[i]
        if c < "\x80" or (unicodedata.category(c)[0] == "L" and not ("ᄀ" <= c <= "ᇿ" or "ꥠ" <= c <= "꥿" or "ힰ" <= c <= "퟿")):
            return i
    return 0


def _between(text: str, i: int) -> bool:
    """Whether no word of the text crosses place ``i`` for sure: white space lies there."""
    return text[i].isspace() and text[i] not in "\x1c\x1d\x1e\x1f"


class Encoder:
    """Feed a text in parts, get ids as soon as they are sure; ``finish`` gives the rest."""

    def __init__(self, tokenizer: Tokenizer):
        self.tok, self.raw, self.text = tokenizer, "", ""

    def feed(self, part: str) -> list[int]:
        self.raw += part
        out, at = [], 0
        for m in self.tok.cut.finditer(self.raw):
            out += self._normal(self.raw[at : m.start()], True)
            out.append(self.tok.special[m.group()])
            at = m.end()
        rest = self.raw[at:]
        keep = _safe_cut(rest[: max(0, len(rest) - self.tok.hold)])
        out += self._normal(rest[:keep], False)
        self.raw = rest[keep:]
        return out

    def finish(self) -> list[int]:
        out = self.feed("") + self._normal(self.raw, True)
        self.raw = ""
        return out

    def _normal(self, part: str, final: bool) -> list[int]:
        if not part.isascii():
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
        text = self.text + part.lower()
        self.text = ""
        if not final:
            # The last words may go on: the last three characters and the words that they are in wait.
            end = max(0, len(text) - 3)
            for m in _WORDS.finditer(text, max(0, len(text) - 64)) if len(text) > 64 and _between(text, len(text) - 64) else _WORDS.finditer(text):
                if m.end() > end:
                    end = min(end, m.start())
            text, self.text = text[:end], text[end:]
        out = self.tok.ids(text)
        if len(self.text) > 4 * (WINDOW + self.tok.lookahead) and (m := _WORDS.match(self.text)) and m.end() == len(self.text):
            ids, n = self.tok.stable(self.text[:-4], False)
            out += ids
            self.text = self.text[n:]
        return out


class Decoder:
    """Ids to text in parts. ``names``: as the file's own decoding, which has none: token names joined by a space;
    else the words themselves, each followed by a space."""

    def __init__(self, tokenizer: Tokenizer, names: bool = False):
        self.pieces, self.glue, self.state = (tokenizer.names, b" ", codecs.getincrementaldecoder("utf-8")("replace")) if names else (tokenizer.bytes, b"", codecs.getincrementaldecoder("utf-8")("replace"))
        self.begun = False

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        data = self.glue.join(map(self.pieces.__getitem__, ids))
        data, self.begun = (self.glue if self.begun else b"") + data, True
        return self.state.decode(data)

    def finish(self) -> str:
        return self.state.decode(b"", True)


def tokenizer(path: str) -> Tokenizer:
    return kept("bpe", path, lambda: Tokenizer(path))


def encode_text(tok: Tokenizer, text: str) -> list[int]:
    enc = Encoder(tok)
    if len(text) <= PART:
        return enc._normal(text, True) if "<|" not in text else enc.feed(text) + enc.finish()
    out: list[int] = []
    for i in range(0, len(text), PART):
        out += enc.feed(text[i : i + PART])
    return out + enc.finish()


def decode_ids(tok: Tokenizer, ids: list[int], names: bool = False) -> str:
    dec = Decoder(tok, names)
    return "".join(dec.feed(ids[i : i + 4096]) for i in range(0, len(ids), 4096)) + dec.finish()


def encode_and_decode(docs: DataFrame, path: str, text: str = "text", names: bool = True) -> DataFrame:
    """``docs`` with columns ids (array of int) and decoded (string) added (underscores in front of taken names)."""
    added = [fresh(docs, "ids"), fresh(docs, "decoded")]
    inner = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(inner, docs.schema, strict=True)] + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                ids, decoded, size, hi = [], [], 0, lo
                while hi < batch.num_rows and (size < 2 << 20 or hi == lo):
                    s = batch.column(at)[hi].as_py() or ""
                    got = encode_text(tok, s)
                    ids.append(np.array(got, np.int32))
                    decoded.append(decode_ids(tok, got, names))
                    size, hi = size + len(s), hi + 1
                part = batch.slice(lo, hi - lo)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(decoded, pa.string())], names=[*inner, "ids", "decoded"])
                lo = hi

    return docs.toDF(*inner).mapInArrow(run, schema).toDF(*docs.columns, *added)

"""Document quality: a linear-chain conditional random field labels every line good or bad.

Each line gets features of its own (share of capitals, symbols, digits, bars, word lengths, repeated words and
three-word runs, repeated line) and those of the lines before and after it. The field is trained on document labels:
every line of a good document is good; a bad document's lines are first all bad, then those that the model finds
clearly good change sides (one line at least stays bad). Forward-backward marginals, weighted by line length,
aggregate into the document's quality: a logistic function of their mean and of the worst line makes the score.

Forward and backward messages of all texts of a slice are one chain of 2 x 2 matrices, with matrices that forget what
was before where a text begins. The chain is cut into blocks of the square root of its length: products per block, then
a message per block, then all blocks side by side. Features are made column by column, so that a text of many short
lines takes some 150 bytes per line.

Defined cases: null and empty texts are one empty line; line breaks alone make empty lines; a very long text is scored
whole; repeated rows score alike; repeated ids of labelled documents are learned from once; no labels, or labels of one
class, give a model that scores every text 1 (nothing is known to be bad). Other columns are carried through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import fresh
from .textbytes import SPACE, Grams, Words, slices
from .toxicity import fit_logistic, sampled

#: Labelled documents learned from at most (those of the smallest hash of the id), and lines of each, one after another
#: from a place that the hash draws, at most.
SAMPLE_ROWS, SAMPLE_LINES = 3_000, 128
_CLASSES = [
    lambda b: 65 <= b <= 90,  # capital letters
    lambda b: 97 <= b <= 122,  # small letters
    lambda b: b >= 128,  # other scripts
    lambda b: 48 <= b <= 57,  # digits
    lambda b: b in b".,;:?'\"()-",  # common punctuation
    lambda b: b == 33,  # exclamation mark
    lambda b: b in b"#$%&*@^~+=<>{}[]\\/_`",  # symbols
    lambda b: b == 124,  # bar
]
_CLASS = np.array([next((i for i, f in enumerate(_CLASSES) if f(b)), len(_CLASSES)) for b in range(256)])
#: A share of one over this already counts as full: bars between words are a tenth of a line.
_FULL = (1, 1, 1, 4, 4, 6, 6, 8)
OWN = len(_CLASSES) + 7


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, and where each row's lines begin; every row has a line at least."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    per = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    return start, end, np.concatenate([[0], np.cumsum(per)])


def _repeated(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """True where the same value came before in the same group."""
    order = np.lexsort((np.arange(len(values)), values, groups))
    out = np.zeros(len(values), bool)
    out[order[1:]] = (values[order][1:] == values[order][:-1]) & (groups[order][1:] == groups[order][:-1])
    return out


def _columns(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> Iterator[np.ndarray]:
    """The lines' own features, one after the other."""
    n, size = len(start), np.maximum(end - start, 0)
    kinds = _CLASS[data]
    for i in range(len(_CLASSES)):
        sums = np.concatenate([[0], np.cumsum(kinds == i)])
        yield np.minimum(_FULL[i] * (sums[end] - sums[start]) / np.maximum(size, 1), 1)
    words = Words(data, offsets, SPACE)
    h = words.hashes()
    first = np.searchsorted(words.start, start)
    count = np.searchsorted(words.start, end) - first
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(words.doc))
    yield np.log1p(size) / 8
    yield np.minimum(size / np.maximum(count, 1), 20) / 10
    repeats = np.concatenate([[0], np.cumsum(_repeated(row, h))])
    yield (repeats[first + count] - repeats[first]) / np.maximum(count, 1)
    three = np.zeros(len(h), bool)
    if len(h) >= 3:
        three[: len(h) - 2] = _repeated(row[: len(h) - 2], Grams(h).at(np.arange(len(h) - 2), 3))
    repeats = np.concatenate([[0], np.cumsum(three)])
    yield (repeats[first + count] - repeats[first]) / np.maximum(count, 1)
    text = np.zeros(n, np.uint64)
    full = np.flatnonzero(count > 0)
    if len(full):
        text[full] = Grams(h).at(first[full], count[full])
    yield _repeated(np.repeat(np.arange(len(offsets) - 1), np.diff(doc)), text).astype(float)
    yield (size == 0).astype(float)
    yield (count <= 2).astype(float)


#: Places in the weights: own features, squares of the first 12 (a line may be bad for too much as well as for too
#: little of something), the line before, the line after, and a constant.
_SQUARES, _BEFORE, _AFTER, WIDTH = OWN, OWN + 12, 2 * OWN + 12, 3 * OWN + 13


def line_scores(data: np.ndarray, offsets: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every line's log-potential of good, the lines' lengths, and where each row's lines begin."""
    start, end, doc = _lines(data, offsets)
    own, before, after = (np.zeros(len(start)) for _ in range(3))
    for i, x in enumerate(_columns(data, offsets, start, end, doc)):
        own += weight[i] * x
        if i < 12:
            own += weight[_SQUARES + i] * x * x
        before += weight[_BEFORE + i] * x
        after += weight[_AFTER + i] * x
    inner = np.ones(len(start), bool)
    inner[doc[:-1]] = False
    own[1:] += before[:-1] * inner[1:]
    own[:-1] += after[1:] * inner[1:]
    return own + weight[-1], np.maximum(end - start, 0), doc


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The feature rows that ``line_scores`` weighs, of every line, the lines' lengths, and where each row's lines begin."""
    start, end, doc = _lines(data, offsets)
    own = np.column_stack(list(_columns(data, offsets, start, end, doc)))
    inner = np.ones(len(start), bool)
    inner[doc[:-1]] = False
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1] * inner[1:, None]
    after[:-1] = own[1:] * inner[1:, None]
    return np.hstack([own, own[:, :12] ** 2, before, after, np.ones((len(own), 1))]), np.maximum(end - start, 0), doc


@dataclass
class Model:
    """Weight of each feature for "good", the log-potentials of [bad, good] following each other, and the calibration."""

    weight: np.ndarray
    follow: np.ndarray
    logistic: np.ndarray | None = None


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices, scaled so that the largest entry is 1."""
    out = a[:, :, :1] * b[:, None, 0] + a[:, :, 1:] * b[:, None, 1]
    return out / out.max((1, 2), keepdims=True)


def _messages(steps: np.ndarray) -> np.ndarray:
    """The row vectors ``v_t = v_{t-1} steps[t]``, from ``(1, 1)`` on, each scaled to a sum of 1; blocks side by side."""
    n = len(steps)
    size = max(1, math.isqrt(n))
    blocks = -(-n // size)
    padded = np.concatenate([steps, np.broadcast_to(np.eye(2), (blocks * size - n, 2, 2))]).reshape(blocks, size, 2, 2)
    whole = padded[:, 0]
    for j in range(1, size):
        whole = _times(whole, padded[:, j])
    v = np.full((blocks, 2), 0.5)
    for b in range(1, blocks):
        x = v[b - 1] @ whole[b - 1]
        v[b] = x / x.sum()
    out = np.empty((blocks, size, 2))
    for j in range(size):
        v = v[:, :1] * padded[:, j, 0] + v[:, 1:] * padded[:, j, 1]
        v = v / v.sum(1, keepdims=True)
        out[:, j] = v
    return out.reshape(-1, 2)[:n]


def marginals(score: np.ndarray, follow: np.ndarray, doc: np.ndarray, line_weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all rows at once: every line's probability of good, and the expected pairs, weighted."""
    first = doc[:-1]
    emit = np.column_stack([np.zeros(len(score)), np.clip(score, -200, 200)])
    steps = np.clip(follow, -50, 50)[None] + emit[:, None, :]
    steps[first] = emit[first][:, None, :]  # both rows alike: nothing of the text before is left
    steps = np.exp(steps - steps.max((1, 2), keepdims=True))
    forward = _messages(steps)
    # Backward: b_{t-1} = steps[t] b_t, from (1, 1) on; the first line of the next text makes it (1, 1) again.
    backward = np.full((len(score), 2), 0.5)
    backward[:-1] = _messages(np.swapaxes(steps[:0:-1], 1, 2))[::-1] if len(score) > 1 else backward[:-1]
    both = forward * backward
    good = both[:, 1] / np.maximum(both.sum(1), 1e-300)
    inner = np.ones(len(score), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    pairs = forward[at - 1][:, :, None] * steps[at] * backward[at][:, None, :]
    pairs /= np.maximum(pairs.sum((1, 2), keepdims=True), 1e-300)
    return good, (pairs if line_weight is None else pairs * line_weight[at, None, None]).sum(0)


def _fit(x: np.ndarray, y: np.ndarray, doc: np.ndarray, weight: np.ndarray, line_weight: np.ndarray, steps: int, ridge: float = 1e-3) -> Model:
    """Gradient ascent (Adam) on the conditional likelihood of the lines' labels, documents weighted by their class."""
    inner = np.ones(len(y), bool)
    inner[doc[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.array([[(((y[at - 1] == a) & (y[at] == b)) * line_weight[at]).sum() for b in (0, 1)] for a in (0, 1)], float)
    theta, n = np.concatenate([weight, np.zeros(4)]), max(1, len(y))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        good, pairs = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), doc, line_weight)
        g = np.concatenate([x.T @ ((y - good) * line_weight), (seen - pairs).ravel()]) / n - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.98**k)) + 1e-8)
    return Model(theta[:-4], theta[-4:].reshape(2, 2))


def _aggregate(model: Model, score: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every line's probability of good; per row the length-weighted mean and its worst line."""
    good, _ = marginals(score, model.follow, doc)
    share = np.maximum(size, 1).astype(float)
    mean = np.add.reduceat(share * good, doc[:-1]) / np.add.reduceat(share, doc[:-1])
    worst = np.maximum.reduceat((1 - good) * np.minimum(share / 40, 1), doc[:-1])
    return good, np.column_stack([mean, worst])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", quality: str = "quality", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, sample_lines: int = SAMPLE_LINES, rounds: int = 3, steps: int = 60) -> Model | None:
    """Fit on the labelled documents (1: good), at most ``sample_rows`` of them; None if they don't hold both classes.

    Features are made on the executors; the driver fits on at most ``sample_lines`` lines of each.
    """
    sample = sampled(docs, labels, quality, sample_rows, key, text).withColumnRenamed("label", "good")

    def features(batches):
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                x, size, doc = line_features(data, offsets)
                spare = np.maximum(np.diff(doc) - sample_lines, 0)
                begin = doc[:-1] + part.column("h").to_numpy().view(np.uint64) % (spare + 1).astype(np.uint64)
                some = [(int(a), int(min(a + sample_lines, b))) for a, b in zip(begin, doc[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("good"), pa.array([x[a:b].astype("<f4").tobytes() for a, b in some], pa.binary()), pa.array([size[a:b].astype("<i4").tobytes() for a, b in some], pa.binary())], ["good", "x", "size"])

    got = sample.mapInArrow(features, "good boolean, x binary, size binary").toPandas()
    label = got["good"].to_numpy(bool)
    if len(set(label.tolist())) < 2:
        return None
    size = [np.frombuffer(s, "<i4") for s in got["size"]]
    doc = np.concatenate([[0], np.cumsum([len(s) for s in size])])
    x, size = np.frombuffer(b"".join(got["x"]), "<f4").reshape(doc[-1], -1), np.concatenate(size)
    of = np.repeat(np.arange(len(label)), np.diff(doc))
    y, model = label[of].astype(float), Model(np.zeros(x.shape[1]), np.zeros((2, 2)))
    balance = np.where(label[of], 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    for k in range(rounds):
        model = _fit(x, y, doc, model.weight, balance, steps)
        if k < rounds - 1:
            good, _ = marginals(x @ model.weight, model.follow, doc)
            worst = np.minimum.reduceat(good, doc[:-1])[of]
            y = np.where(label[of], 1.0, ((good > 0.5) & (good > worst)).astype(float))
    _, values = _aggregate(model, x @ model.weight, size, doc)
    model.logistic = fit_logistic(values, label.astype(float))
    return model


def score_quality(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with columns score, predicted and line_good added (``quality_`` in front where a name is taken).

    ``line_good``: the probability of good of every line of the text (parts between line breaks).
    """
    names = [c if c.lower() not in {x.lower() for x in docs.columns} else fresh(docs, f"quality_{c}") for c in ("score", "predicted", "line_good")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    inner = [f"c{i}" for i in range(len(docs.columns))]
    inner[docs.columns.index(text)] = "text"
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(inner, docs.schema, strict=True)] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("line_good", T.ArrayType(T.FloatType()))])

    def run(batches):
        m = shared.value
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                lines, size, doc = line_scores(data, offsets, np.zeros(WIDTH) if m is None else m.weight)
                if m is None:
                    good, score = np.ones(len(size)), np.ones(len(offsets) - 1)
                else:
                    good, values = _aggregate(m, lines, size, doc)
                    score = 1 / (1 + np.exp(-np.clip(values @ m.logistic[:-1] + m.logistic[-1], -40, 40)))
                lines = pa.ListArray.from_arrays(pa.array(doc.astype(np.int32)), pa.array(good.astype(np.float32)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32)), lines], names=[*inner, "score", "predicted", "line_good"])

    return docs.toDF(*inner).mapInArrow(run, schema).toDF(*docs.columns, *names)

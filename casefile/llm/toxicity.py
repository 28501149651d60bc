"""Toxic passages: maximum-scoring segments of token log-odds, aggregated by extreme-value calibration.

Every token (a word, or its first 4, 5 or 6 bytes, so that inflected forms count together) gets the log-odds of
occurring in toxic against clean training documents, smoothed by a Dirichlet prior proportional to the token's
frequency in both. A word scores the log-odds of its most significant token less a drift, so that clean text loses
score from word to word. A linear scan finds all maximal scoring segments of a text; a segment is a toxic passage if
its expected number in clean text of that length, ``K * n * exp(-lambda * score)``, is small. ``lambda`` solves
``sum p(s) exp(lambda s) = 1`` over the clean words' scores and ``K`` is fitted to the best segments of clean
documents. The document's score is a logistic function of its best and its joint significance.

Defined cases: null and empty texts have no words and score as clean documents without a segment; ties between
equal segments keep text order; repeated rows score alike; an empty label table, or one of a single class, gives a
model that scores every text 0. A very long text is a slice of its own, scanned in time and memory linear in its length.
Other columns are carried through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, takes_over
from .textbytes import NOT_ALNUM, U, Words, lowered, slices

#: Labelled documents learned from at most (those of the smallest hash of the id).
SAMPLE_ROWS = 12_000
#: The calibration scores each fold of the sample with the tokens of the others, as new texts would be scored.
FOLDS = 4
PREFIXES = (None, 4, 5, 6)
_BLOOM = 1 << 22
#: Bytes of text scanned at once; a word takes several hashes, each of an array of its own.
SCAN_BYTES = 1 << 18


def _tokens(words: Words) -> list[np.ndarray]:
    """Per kind of token the hash of every word's token; 0 where the word is no longer than the prefix."""
    out = []
    for k, most in enumerate(PREFIXES):
        h = words.hashes(most) ^ U(k)
        out.append(h if most is None else np.where(words.end - words.start > most, h, U(0)))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token, documents of each label and fold that hold it."""
    takes_over("toxicity")
    for batch in batches:
        for part, data, offsets in slices(batch, "text"):
            words = Words(lowered(data), offsets, NOT_ALNUM)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(words.doc))
            toxic, fold = part.column("toxic").to_numpy(zero_copy_only=False).astype(bool), part.column("fold").to_numpy()[row]
            for h, f in ((h, f) for h in _tokens(words) for f in range(FOLDS)):
                seen = (h != 0) & (fold == f)
                order = np.lexsort((row[seen], h[seen]))
                hs, rs = h[seen][order], row[seen][order]
                first = np.ones(len(hs), bool)
                first[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
                hs, bad = hs[first], toxic[rs[first]]
                values, starts = np.unique(hs, return_index=True)
                if len(values):
                    bad = np.add.reduceat(bad.astype(np.int64), starts)
                    total = np.diff(np.append(starts, len(hs)))
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(bad), pa.array(total - bad), pa.array(np.full(len(values), f, np.int32))], ["token", "n_toxic", "n_clean", "fold"])


@dataclass
class Model:
    """Tokens in ascending order with their log-odds and significance, the drift, and the calibration."""

    tokens: np.ndarray
    odds: np.ndarray
    weight: np.ndarray
    drift: float = 1.0
    lam: float = 1.0
    k: float = 0.1
    logistic: tuple[float, float, float] = (0.0, 0.0, -50.0)

    def scores(self, words: Words) -> np.ndarray:
        """Every word's score."""
        if not hasattr(self, "_bloom"):
            self._bloom = np.zeros(_BLOOM, bool)
            self._bloom[(self.tokens & U(_BLOOM - 1)).astype(np.int64)] = True
        best, out = np.zeros(len(words.start)), np.zeros(len(words.start))
        for h in _tokens(words) if len(self.tokens) else []:
            at = np.flatnonzero(self._bloom[(h & U(_BLOOM - 1)).astype(np.int64)])
            i = np.minimum(np.searchsorted(self.tokens, h[at]), len(self.tokens) - 1)
            hit = (self.tokens[i] == h[at]) & (self.weight[i] > best[at])
            at, i = at[hit], i[hit]
            best[at], out[at] = self.weight[i], self.odds[i]
        return out - self.drift


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(from, to, score)`` of a sequence, in order; linear in its length."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float]] = []
    for i in np.flatnonzero(scores > 0).tolist():
        new = (i, i + 1, sums[i], sums[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = (stack[j][0], new[1], stack[j][2], new[3])
            del stack[j:]
    return [(a, b, float(r - left)) for a, b, left, r in stack]


def _solve(values: np.ndarray, share: np.ndarray) -> float:
    """The positive lambda with ``sum share * exp(lambda * value) = 1``."""
    if not (values > 0).any():
        return 1.0
    low, high = 1e-6, 1.0
    f = lambda x: float((share * np.exp(x * values)).sum()) - 1
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def _features(model: Model, n_words: int, found: list[tuple[int, int, float]]) -> tuple[float, float]:
    """How significant the best segment and all segments together are (minus log of the expected number)."""
    if not found:
        return 0.0, 0.0
    base = np.log(max(model.k * n_words, 1e-9))
    each = [max(model.lam * s - base, 0.0) for *_, s in found]
    return float(np.log1p(max(each))), float(np.log1p(sum(each)))


def _scan(model: Model, batch: pa.RecordBatch):
    for part, data, offsets in slices(batch, "text", SCAN_BYTES):
        words = Words(lowered(data), offsets, NOT_ALNUM)
        scores = model.scores(words)
        positive = np.concatenate([[0], np.cumsum(scores > 0)])[words.doc]
        yield part, words, scores, [segments(scores[a:b]) if q > p else [] for a, b, p, q in zip(words.doc[:-1], words.doc[1:], positive[:-1], positive[1:], strict=True)]


def sampled(docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(text, label, h)`` of the ``rows`` labelled documents of the smallest hash of the id, the label as a boolean.

    Only ids and labels are sorted; at most ``rows`` of them are broadcast to the documents. Of documents that share an id
    that of the least hash is taken."""
    few = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), (F.col(label) == 1).alias("label"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    few = few.orderBy("h", "id").limit(rows).select("id", "label", "h")
    few = few.groupBy("id").agg(F.min("label").alias("label"), F.min("h").alias("h"))
    found = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(few), "id")
    return found.groupBy("id").agg(F.min_by(F.struct("text", "label", "h"), F.xxhash64("text")).alias("d")).select("d.text", "d.label", "d.h")


def train(docs: DataFrame, labels: DataFrame, text: str = "text", toxic: str = "toxic", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, least_docs: int = 4, least_z: float = 2.0, prior: float = 500.0, drift: float = 1.0) -> Model:
    """Fit on the labelled documents (1: toxic), at most ``sample_rows`` of them; null labels are left out.

    Counting runs on the executors; the driver gets the sample's significant tokens, each in ``least_docs`` documents or
    more of it, and a few numbers per sampled row: the sample bounds both, whatever the size of the corpus and of a text.
    """
    spark = docs.sparkSession
    sample = sampled(docs, labels, toxic, sample_rows, key, text).select("text", F.col("label").alias("toxic"), F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"))
    sample = sample.repartition(max(4, spark.sparkContext.defaultParallelism)).persist()
    n = {(r["toxic"], r["fold"]): r["count"] for r in sample.groupBy("toxic", "fold").count().collect()}
    size = {y: sum(v for (label, _), v in n.items() if label == y) for y in (True, False)}
    if not all(size.values()):
        sample.unpersist()
        return Model(np.zeros(0, U), np.zeros(0), np.zeros(0))
    counts = sample.mapInArrow(_count, "token long, n_toxic long, n_clean long, fold int").groupBy("token")
    of = lambda c, f: F.sum(F.when(F.col("fold") != f, F.col(c)).otherwise(0))
    counts = counts.agg(*[of(c, f).alias(f"{c}{f}") for c in ("n_toxic", "n_clean") for f in range(-1, FOLDS)])
    columns = []
    for f in range(-1, FOLDS):
        t, c, nt, nc = F.col(f"n_toxic{f}"), F.col(f"n_clean{f}"), *(size[y] - n.get((y, f), 0) for y in (True, False))
        alpha = prior * (t + c) / max(1, nt + nc)
        side = lambda y, of_all, alpha=alpha: F.log((y + alpha + 0.01) / (of_all - y + prior - alpha + 0.01))
        z = (side(t, nt) - side(c, nc)) / F.sqrt(1 / (t + alpha + 0.01) + 1 / (c + alpha + 0.01))
        # The prior decides what is significant; the score is the plain log-odds, which it would pull to 0.
        plain = F.log((t + 0.1) / (nt + 0.2)) - F.log((c + 0.1) / (nc + 0.2))
        columns += [F.greatest(F.lit(-3.0), F.least(F.lit(8.0), plain)).alias(f"odds{f}"), F.when((F.abs(z) >= least_z) & (t + c >= least_docs), F.abs(z)).otherwise(0.0).alias(f"z{f}")]
    kept = counts.select("token", *columns).withColumn("z", F.greatest(*[f"z{f}" for f in range(-1, FOLDS)])).where("z > 0").toPandas()
    kept["token"] = kept["token"].to_numpy().astype(np.int64).view(U)
    kept = kept.sort_values("token")

    def fitted(f: int) -> Model:
        own = kept[kept[f"z{f}"] > 0]
        return Model(own["token"].to_numpy(), own[f"odds{f}"].to_numpy(float), own[f"z{f}"].to_numpy(float), drift)

    model, others = fitted(-1), [fitted(f) for f in range(FOLDS)]

    def measure(batches):
        for batch in batches:
            for f, other in enumerate(others):
                for part, words, scores, found in _scan(other, batch.filter(pa.array(batch.column("fold").to_numpy() == f))):
                    bad = part.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
                    clean = np.repeat(~bad, np.diff(words.doc))
                    values, share = np.unique(np.round(scores[clean] * 4) / 4, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(bad), pa.array(np.diff(words.doc)), pa.array([max((s for *_, s in x), default=0.0) for x in found]), pa.array([dict(zip(values.tolist(), share.tolist(), strict=True))] + [None] * (len(found) - 1), pa.map_(pa.float64(), pa.int64()))], ["toxic", "n", "best", "clean"])

    seen = sample.mapInArrow(measure, "toxic boolean, n long, best double, clean map<double,long>").toPandas()
    share: dict[float, int] = {}
    for m in seen["clean"].dropna():
        for v, c in dict(m).items():
            share[v] = share.get(v, 0) + c
    values = np.array(sorted(share))
    model.lam = min(_solve(values, np.array([share[v] for v in values]) / max(1, sum(share.values()))), 8.0) if len(values) else 1.0
    clean = seen[~seen["toxic"] & (seen["n"] > 0)]
    # Moments: the mean number of clean documents' segments above 0 gives K.
    expected = np.exp(-model.lam * clean["best"].to_numpy(float)) * clean["n"].to_numpy(float)
    model.k = float(1.0 / max(np.mean(expected), 1.0)) if len(clean) else 0.1

    def weigh(batches):
        for batch in batches:
            for f, other in enumerate(others):
                other.lam, other.k = model.lam, model.k
                for part, words, _, found in _scan(other, batch.filter(pa.array(batch.column("fold").to_numpy() == f))):
                    x = np.array([_features(other, k, some) for k, some in zip(np.diff(words.doc), found, strict=True)]).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.float64()), pa.array(x[:, 0]), pa.array(x[:, 1])], ["toxic", "a", "b"])

    # Segments stay with the executors: two numbers per sampled row come here.
    weighed = sample.withColumn("toxic", F.col("toxic").cast("double")).mapInArrow(weigh, "toxic double, a double, b double").toPandas()
    sample.unpersist()
    model.logistic = tuple(fit_logistic(weighed[["a", "b"]].to_numpy(float).reshape(-1, 2), weighed["toxic"].to_numpy(float)))
    return model


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and intercept of a logistic regression, by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def find_toxic(docs: DataFrame, model: Model, text: str = "text", alpha: float = 0.05, threshold: float = 0.7) -> DataFrame:
    """``docs`` with columns score, predicted and passages added (``toxic_`` in front where a name is taken).

    ``passages``: array of (from_word, to_word, score, expected) of every segment whose expected number in clean
    text is at most ``alpha``; word positions count runs of letters and digits.
    """
    names = [c if c.lower() not in {x.lower() for x in docs.columns} else fresh(docs, f"toxic_{c}") for c in ("score", "predicted", "passages")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the sample's significant tokens
    at = docs.columns.index(text)
    inner = [f"c{i}" for i in range(len(docs.columns))]
    inner[at] = "text"
    passage = T.ArrayType(T.StructType([T.StructField("from_word", T.LongType()), T.StructField("to_word", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))
    kind = pa.list_(pa.struct([("from_word", pa.int64()), ("to_word", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(inner, docs.schema, strict=True)] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", passage)])

    def run(batches):
        takes_over("toxicity")
        m = shared.value
        for batch in batches:
            for part, words, _, found in _scan(m, batch):
                n = np.diff(words.doc)
                x = np.array([_features(m, k, f) for k, f in zip(n, found, strict=True)]).reshape(len(n), 2)
                score = 1 / (1 + np.exp(-np.clip(x @ np.array(m.logistic[:2]) + m.logistic[2], -40, 40)))
                passages = [[{"from_word": a, "to_word": b, "score": s, "expected": e} for a, b, s in f if (e := m.k * k * float(np.exp(-m.lam * s))) <= alpha] for k, f in zip(n, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(passages, kind)], names=[*inner, "score", "predicted", "passages"])

    return docs.toDF(*inner).mapInArrow(run, schema).toDF(*docs.columns, *names)

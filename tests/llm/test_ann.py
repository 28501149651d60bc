import numpy as np
from pyspark.sql import functions as F

from casefile.llm import ann


def brute(ids, x, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, q in zip(ids, unit):
        if i % 50 == 0:
            s = [(-round(float(v), 12), j) for v, j in zip(unit @ q, ids) if j != i]
            out[i] = [j for _, j in sorted(s)[:k]]
    return out


def test_recall(spark, monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(10, 32))
    x = (centres[rng.integers(0, 10, 4000)] + rng.normal(size=(4000, 32))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 20)
    monkeypatch.setattr(ann, "CELL_ROWS", 200)
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    want = brute(range(4000), x.astype(float), 5)
    found = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want}
    assert np.mean([len(set(found[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    r = got[0]
    a, b = x[r["query_id"]].astype(float), x[r["vec_id"]].astype(float)
    assert abs(r["score"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_thousands_of_jittered_copies(spark, monkeypatch):
    """Their codes tie or nearly so; the queries are among them. Of 4 cells all are looked at, of 64 8 or more."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 64))
    x[:4000] = x[0] + 0.02 * rng.normal(size=(4000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for cell_rows, least in ((1000, 1.0), (100, 0.9)):
        monkeypatch.setattr(ann, "CELL_ROWS", cell_rows)
        recall = []
        got = ann.nearest(docs, (F.col("vec_id") % 50 == 0) & (F.col("vec_id") < 4000)).collect()
        for q in range(0, 4000, 50):
            s = unit @ unit[q]
            s[q] = -2
            recall.append(len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-s)[:5].tolist())) / 5)
        print("recall", cell_rows, np.mean(recall))
        assert np.mean(recall) >= least


def test_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[100:300] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [100, 101, 102, 103, 104] and [r["rank"] for r in got] == [1, 2, 3, 4, 5]


def test_edge_cases(spark):
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [None, 1.0], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (50, [0.0, 3.0], 1), (7, [1.0], 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = sorted(tuple(r) for r in ann.nearest(docs, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 6, 1.0), (0, 2, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 6, 0.0)]
    assert ann.nearest(docs.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(docs.limit(1), F.lit(True)).count() == 0


def exact(rows, k):
    """By plain loops over fractions of whole numbers' squares: every query row's k nearest rows but itself."""
    from fractions import Fraction
    from math import sqrt

    def cosine(a, b):
        a, b = [Fraction(x) for x in a], [Fraction(x) for x in b]
        top, low = sum(x * y for x, y in zip(a, b)), sum(x * x for x in a) * sum(x * x for x in b)
        return (1 if top > 0 else -1) * sqrt(top * top / low)

    out = []
    for n, (i, v) in enumerate(rows):
        if i % 50 == 0:
            near = sorted((-cosine(v, w), j) for m, (j, w) in enumerate(rows) if m != n)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(near, 1)]
    return sorted(out)


def close(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want))


def test_repeated_rows_are_candidates(spark):
    rows = [(0, [1.0, 0.2])] + [(7, [1.0, 0.1])] * 7 + [(i, [1.0, float(i)]) for i in range(10, 28)] + [(50, [1.0, 0.1])] * 3
    got = sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect())
    close(got, exact(rows, 5))
    few = [(0, [1.0, 0.2]), (3, [1.0, 1.0]), (3, [1.0, 1.0])]
    got = sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(few, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect())
    close(got, exact(few, 5))


def test_extreme_components(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e199]), (2, [3e-320, 0.0]), (3, [-1e300, 1e300]), (50, [5e-324, 5e-324]), (4, [1e-200, 2e-200]), (5, [1.0, 1e-300])]
    got = sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect())
    close(got, exact(rows, 5))

import itertools

import numpy as np
from pyspark.sql import functions as F

from casefile.llm import quality
from casefile.llm.shared import held_out


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    doc = np.array([0, 1, 4, 9, 17])
    score, follow, weight = 3 * rng.normal(size=17), rng.normal(size=(2, 2)), rng.random(17)
    good, pairs = quality.marginals(score, follow, doc, weight)
    want, want_pairs = np.zeros(17), np.zeros((2, 2))
    for a, b in itertools.pairwise(doc.tolist()):
        weights = {}
        for y in itertools.product((0, 1), repeat=b - a):
            weights[y] = np.exp(sum(score[a + i] * v for i, v in enumerate(y)) + sum(follow[u, v] for u, v in itertools.pairwise(y)))
        total = sum(weights.values())
        for y, w in weights.items():
            for i, v in enumerate(y):
                want[a + i] += v * w / total
            for i, (u, v) in enumerate(itertools.pairwise(y), 1):
                want_pairs[u, v] += weight[a + i] * w / total
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs)


def test_long_chain_by_a_plain_loop():
    rng = np.random.default_rng(1)
    n = 20_011
    score, follow, doc = 20 * rng.normal(size=n), 3 * rng.normal(size=(2, 2)), np.array([0, n])
    good, _ = quality.marginals(score, follow, doc)
    emit = np.column_stack([np.zeros(n), score])
    f, b = np.zeros((n, 2)), np.zeros((n, 2))
    f[0] = emit[0]
    for t in range(1, n):
        f[t] = emit[t] + np.logaddexp(f[t - 1, 0] + follow[0], f[t - 1, 1] + follow[1])
    for t in range(n - 2, -1, -1):
        x = emit[t + 1] + b[t + 1]
        b[t] = np.logaddexp(follow[:, 0] + x[0], follow[:, 1] + x[1])
    assert np.allclose(good, 1 / (1 + np.exp(np.clip((f + b)[:, 0] - (f + b)[:, 1], -600, 600))))


def test_scores_are_weighed_features():
    text = "One line here.\n\n!!! $$$ 12 | 12 | 12\nOne line here.\n\n".encode()
    data, offsets = np.frombuffer(text * 3, np.uint8), np.array([0, 7, 7, len(text), len(text) * 3])
    weight = np.random.default_rng(2).normal(size=quality.WIDTH)
    x, size, doc = quality.line_features(data, offsets)
    score, size2, doc2 = quality.line_scores(data, offsets, weight)
    assert np.allclose(x @ weight, score) and (size == size2).all() and (doc == doc2).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, labels.where(~held_out(F.col("doc_id"))))
    out = quality.score_quality(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("predicted", "quality").toPandas()
    assert (out.predicted == out.quality).mean() > 0.93
    good = out[out.quality == 1]
    assert (good.predicted == 1).mean() > 0.97


def test_edge_cases(spark):
    docs = spark.createDataFrame([(i, "BUY!!! $$$ NOW\n" * 4 if i % 2 else "The sea was calm that day.\nWe walked home.", "x") for i in range(60)] + [(70, None, "x"), (71, "", "x"), (72, "\n\n", "x"), (None, "fine words here", "x")], "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = quality.score_quality(docs, model)
    assert out.columns == ["doc_id", "text", "predicted", "score", "quality_predicted", "line_good"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[0]["quality_predicted"] == 1 and got[1]["quality_predicted"] == 0
    assert len(got[70]["line_good"]) == 1 and len(got[72]["line_good"]) == 3 and 0 <= got[71]["score"] <= 1
    assert quality.train(docs, labels.where("quality = 1")) is None
    assert quality.score_quality(docs, None).where("score < 1").count() == 0
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_long_texts_and_repeated_rows(spark):
    """A hundred thousand short lines, a line of a million words, line breaks alone; labelled ids that come again."""
    rows = [(i, "BUY!!! $$$ NOW\n" * 4 if i % 2 else "The sea was calm that day.\nWe walked home.") for i in range(60)]
    long = [(100, "a\n" * 100_000), (101, "word " * 1_000_000), (102, "\n" * 300_000), (1, rows[1][1])]
    docs = spark.createDataFrame(rows + long + [(0, "The sea again.")] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(100, 0), (102, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels, sample_lines=50)
    out = quality.score_quality(docs, model).selectExpr("doc_id", "score", "size(line_good) as n").collect()
    assert {r["n"] for r in out if r["doc_id"] >= 100} == {100_001, 1, 300_001} and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 1}) == 1 and len(out) == 364

import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casefile.llm import toxicity
from casefile.llm.shared import held_out


def recursive(scores, lo, hi):
    """Maximal segments by definition: the best one, then those left and right of it."""
    best = None
    for a in range(lo, hi):
        for b in range(a + 1, hi + 1):
            s = sum(scores[a:b])
            if s > 0 and (best is None or s > best[0] or (s == best[0] and b - a < best[2] - best[1])):
                best = (s, a, b)
    if not best:
        return []
    s, a, b = best
    return [*recursive(scores, lo, a), (a, b, s), *recursive(scores, b, hi)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-5, 5).map(lambda x: x + 0.0), max_size=14))
def test_segments(scores):
    got = toxicity.segments(np.array(scores))
    want = recursive(scores, 0, len(scores))
    assert sorted(s for *_, s in got) == sorted(s for *_, s in want)
    assert all(sum(scores[a:b]) == s for a, b, s in got)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels.where(~held_out(F.col("doc_id"))))
    out = toxicity.find_toxic(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("predicted", "toxic").toPandas()
    hit = ((out.predicted == 1) & (out.toxic == 1)).sum()
    # Few labels here: about ten toxic documents a language other than English.
    assert hit / (out.toxic == 1).sum() > 0.75 and hit / (out.predicted == 1).sum() > 0.9


def test_scan_works_in_bounded_memory():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, 100)) for _ in range(8000)]
    tokens = np.arange(1, 5, dtype=np.uint64)
    model, batch = toxicity.Model(tokens, np.ones(len(tokens)), np.ones(len(tokens))), pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    list(toxicity._scan(model, batch.slice(0, 1)))
    tracemalloc.start()
    n = 0
    for part, *_ in toxicity._scan(model, batch):
        n += part.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts) and peak < 32 << 20, peak


def test_edge_cases(spark):
    bad = "you are a rotten turnip indeed"
    docs = spark.createDataFrame([(i, bad if i % 2 else f"a quiet day by the sea {i % 7}", "x") for i in range(80)] + [(90, None, "x"), (91, "", "x"), (92, "TURNIP " * 5 + "fine " * 50 + "rotten turnip", "x"), (92, "sea", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(91, None), (500, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.find_toxic(docs, model)
    assert out.columns == ["doc_id", "text", "score", "toxic_score", "predicted", "passages"]
    got = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert got[90, None]["predicted"] == 0 and got[91, ""]["predicted"] == 0 and got[1, bad]["toxic_score"] > got[0, "a quiet day by the sea 0"]["toxic_score"]
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.find_toxic(docs, none).where("predicted = 1").count() == 0
    assert toxicity.find_toxic(docs.limit(0), model).count() == 0

import math
import re
from collections import Counter

import pytest

from casefile.llm import lexical as L

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in PATTERN.findall(text or "")]


def brute(docs, items, k=20):
    held = [(i, Counter(t), len(t)) for i, x in docs if (t := terms(x))]
    n_docs, n_terms, df = len(held), sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        if item is None:
            continue
        ranked = []
        for i, c, n in held:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                ranked.append((i, score))
        ranked.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(item, r, i, s) for r, (i, s) in enumerate(ranked[:k], 1)]
    return sorted(out, key=repr)


def ranked(spark, docs, items, **kw):
    got = L.rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **kw)
    return sorted((tuple(r) for r in got.collect()), key=repr)


WORDS = ["alpha", "Beta", "γάμμα", "Δέλτα", "über", "x9", "the", "of", "and", "ßharp", "ﬀ", "日本"]


def corpus(n):
    return [(i, " ".join(WORDS[(i * 7 + j * j + i // 3) % len(WORDS)] for j in range(1 + i % 17)) + ("." if i % 2 else " the the")) for i in range(n)]


ITEMS = [(0, "the alpha of ALPHA"), (1, "Δέλτα δέλτα, 日本; x9!"), (2, "nowhere at all"), (3, "beta-über beta"), (3, "and and"), (4, None), (5, ""), (None, "alpha"), (6, "the")]


def test_terms():
    assert [t.decode() for t in L.terms("A_b-C9é ÀB x\tİ\x00z".encode())] == terms("A_b-C9é ÀB x\tİ\x00z") == ["a", "b", "c9é", "Àb x", "İ", "z"]


@pytest.mark.parametrize("owners", [1, 3, 4])
def test_equals_brute_force(spark, owners):
    docs = corpus(150)
    want = brute(docs, ITEMS)
    assert len(want) > 60 and ranked(spark, docs, ITEMS, owners=owners) == want


def test_shards_and_bundles_change_nothing(spark, monkeypatch):
    docs = corpus(90)
    want = brute(docs, ITEMS, 4)
    for name, value in (("SHARD_DOCS", 7), ("BUNDLE_ITEMS", 2), ("BUNDLE_TERMS", 3), ("ADDS", 5), ("SLOTS", 4)):
        monkeypatch.setattr(L, name, value)
    assert ranked(spark, docs, ITEMS, k=4) == want


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,"), (None, "alpha beta"), (4, "alpha beta"), (4, "alpha beta"), (5, "alpha beta"), (6, "gamma"), (7, "delta " * 30_000 + "alpha"), *((i, "copy of the beta") for i in range(100, 140))]
    items = [(0, "alpha"), (1, "beta"), (2, "delta delta"), (3, "copy of the")]
    assert ranked(spark, docs, items) == brute(docs, items)
    assert ranked(spark, docs, []) == []
    assert ranked(spark, [], items) == []
    assert ranked(spark, [(1, None)], items) == []


def test_extra_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F

    docs, items = corpus(40), ITEMS[:3]
    extra = {c: F.lit("x") for c in ("row", "owner", "n", "terms", "counts", "shard", "bundle", "item", "rank", "score", "m")}
    got = L.rank_documents(spark.createDataFrame(docs, "doc_id long, text string").withColumns(extra), spark.createDataFrame(items, "item_id long, text string").withColumns(extra))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)

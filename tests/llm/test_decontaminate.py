import random
import re

import numpy as np
import pytest

from casefile.llm.decontaminate import Index, _hashes, allowed, find_items

W = [f"{a}{b}{c}" for a in "klmnp" for b in "aeiou" for c in "rstxz"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def expected(rows, items):
    """Every place by plain dynamic programming: the nearest part first, then those that don't overlap it."""
    out = []
    for d, text in rows:
        words = re.findall(r"\w+", text.lower())
        for i, item in items:
            item, most = item.split(), len(item.split()) // 5
            ends, row = [], list(range(len(item) + 1))
            for e, y in enumerate(words, 1):
                new = [0]
                for j, x in enumerate(item, 1):
                    new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
                row = new
                ends += [(row[-1], e)] if row[-1] <= most else []
            taken = set()
            for near, e in sorted(ends):
                start = next(s for s in range(e, -1, -1) if distance(item, words[s:e]) == near)
                if start < e and not taken & set(range(start, e)):
                    taken |= set(range(start, e))
                    out.append((d, i, near, len(item), start, e))
    return sorted(out)


def test_finds_what_brute_force_finds(spark):
    """Items of 1 to 90 words, with no to too many edits, alone and again and again: nothing else, and nearly all."""
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(W) for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 5, 6, 7, 9, 11, 14, 15, 16, 20, 24, 31, 32, 38, 45, 59, 64, 65, 90])]
    rows = []
    for i in range(120):
        text = [rng.choice(W) for _ in range(rng.randint(0, 60))]
        _, t = items[i % len(items)]
        t = t.split() * (1 + 3 * (i % 7 == 0))
        for _ in range(rng.randint(0, int(0.25 * len(t)))):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], ["zzz"], [t[k], "yyy"]])
            t = t or ["q"]
        at = rng.randint(0, len(text))
        text[at:at] = t
        rows.append((i, " ".join(text).upper() if i % 3 == 0 else ", ".join(text)))
    got = find_items(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got, want = sorted(tuple(r) for r in got.collect()), expected(rows, items)
    print(len(got), "of", len(want), set(want) ^ set(got))
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) and len(want) > 100


@pytest.mark.parametrize("n", [5, 9, 15, 24, 38, 59, 100, 300])
def test_recall_at_the_bound(n):
    """Items with as many edits as are allowed, anywhere, or all in their first third: share found, of 200."""
    rng, found = random.Random(n), []
    items = [(k, " ".join(f"w{rng.randrange(1 << 40)}" for _ in range(n))) for k in range(200)]
    index = Index(items, 0.2, 0.999)
    for part in (1, 3):
        texts = []
        for _, t in items:
            t = t.split()
            for _ in range(allowed(n)):
                k = rng.randrange(max(1, len(t) // part))
                t[k : k + 1] = rng.choice([[], ["zzz"], [t[k], "yyy"]])
            texts.append(" ".join(["x"] * 9 + t + ["y"] * 9).encode())
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        places = index.places(*_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets))
        found.append(len({r for r, i, *_ in places if r == i}) / 200)
    print(n, found)
    assert found[0] >= 0.98 and found[1] >= 0.95


def test_long_documents_and_blocks(spark):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice(W) for _ in range(30))) for i in range(40)]
    text = " ".join(rng.choice(W) for _ in range(60_000)) + " " + items[7][1] + " " + " ".join(rng.choice(W) for _ in range(60_000))
    docs, bench = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 1500):
        got = find_items(docs, bench, block_bytes=block).collect()
        assert [(r["item_id"], r["distance"], r["from_word"], r["to_word"]) for r in got] == [(7, 0, 60_000, 60_030)]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "one two three four", 0), (3, "one two three four", 0), (None, "ONE-two three four!", 0)], "doc_id long, text string, distance int")
    bench = spark.createDataFrame([(1, "two three four"), (2, "two three four"), (3, "two"), (4, None), (5, ""), (6, "two three five")], "item_id long, text string")
    got = sorted(((r[0], r[1], r[2]) for r in find_items(docs, bench).collect()), key=repr)
    assert got == sorted([(3, 1, 0), (3, 2, 0), (3, 3, 0)] * 2 + [(None, 1, 0), (None, 2, 0), (None, 3, 0)], key=repr)
    assert find_items(docs, bench.limit(0)).count() == 0 and find_items(docs.limit(0), bench).count() == 0


def test_long_items_and_places_in_a_row(spark):
    rng = random.Random(7)
    long = [rng.choice(W) for _ in range(3_000)]
    again = " ".join(rng.choice(W) for _ in range(24))
    text = list(long)
    for i in range(5, 3_000, 10):
        text[i] = "zzz"
    docs = spark.createDataFrame([(1, "a b c " + " ".join(text) + " d"), (2, " ".join([again] * 6)), (3, " ".join(long[:2000]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(long)), (2, again)], "item_id long, text string")
    got = sorted(tuple(r) for r in find_items(docs, bench).collect())
    assert got == [(1, 1, 300, 3000, 3, 3003)] + [(2, 2, 0, 24, 24 * k, 24 * k + 24) for k in range(6)]


def test_blocks_one_after_the_other(spark, monkeypatch):
    """A benchmark of several blocks: the same places, one index at a time, ids of any type."""
    from pyspark import Broadcast
    from pyspark.sql import functions as F

    rng = random.Random(11)
    items = [(i, " ".join(rng.choice(W) for _ in range(rng.randint(3, 30)))) for i in range(60)]
    rows = [(i, " ".join([rng.choice(W), items[i][1], rng.choice(W)])) for i in range(60)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, find_items(docs, benchmark).collect()))
    assert len(one) >= 60
    gone, destroy = [], Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: (gone.append(1), destroy(self, *a)))
    assert sorted(map(tuple, find_items(docs, benchmark, block_bytes=1500).collect())) == one and len(gone) >= 3
    small = benchmark.withColumn("item_id", F.col("item_id").cast("short"))
    assert sorted(map(tuple, find_items(docs, small).collect())) == one
    exact = benchmark.withColumn("item_id", F.col("item_id").cast("decimal(9,2)"))
    assert [(d, int(i), *x) for d, i, *x in sorted(map(tuple, find_items(docs, exact, block_bytes=3000).collect()))] == one

import os
import random
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casefile.llm import bpe, near_dedup
from casefile.llm.near_dedup import banded_distance, near_classes
from casefile.llm.shared import SHUFFLE_CLEANUP, among, components, cut, once, takes_over


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 9))
def test_banded_distance(a, b, most):
    assert banded_distance(a, b, most) == min(distance(a, b), most + 1)


def test_finds_planted_copies(spark):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(5000)]
    rows, groups = [], {}
    for g in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([40, 150, 600]))]
        for _ in range(rng.randint(1, 5)):
            copy = list(text)
            for _ in range(len(text) // 20 if rng.random() < 0.7 else 0):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            groups.setdefault(g, []).append(len(rows))
            rows.append((len(rows), " ".join(copy)))
    # A passage that all share makes large groups of unlike texts.
    passage = " ".join(words[:30])
    first = len(rows)
    rows += [(first + i, passage + " " + " ".join(rng.choice(words) for _ in range(60))) for i in range(80)]
    got = {r["doc_id"]: r["class_id"] for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for ids in groups.values():
        for i in ids:
            assert got[i] == min(ids), (i, ids, got[i])
    for i in range(first, len(rows)):
        assert got[i] == i


def test_edge_cases(spark):
    long = " ".join(f"t{i}" for i in range(50))
    rows = [(1, None, 1), (2, "", 1), (3, "a b", 1), (4, "a b", 1), (5, "a c", 1), (6, long, 1), (7, long, 1), (7, long, 1), (None, long, 1), (8, "x", 1), (8, "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    got = sorted(tuple(r) for r in near_classes(docs).collect())
    assert got == [(1, 1, 0), (2, 1, 0), (3, 3, 0), (4, 3, 0), (5, 5, 0), (6, 6, 0), (7, 6, 0), (8, 8, 0)]
    assert near_classes(docs.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def edited(rng, text, edits):
    """The text with so many words replaced at scattered places."""
    out = list(text)
    for i in rng.sample(range(len(out)), edits):
        out[i] = f"new{rng.random()}"
    return out


def test_members_of_a_group_that_are_unlike_its_least_id(spark, monkeypatch):
    """One group only: its least id is unlike all others, and c is similar to b, a confirmed member, but not to a."""
    monkeypatch.setattr(near_dedup, "order_minhash", lambda data, offsets, sketches, *_: (np.zeros((len(offsets) - 1, sketches), np.uint64) + np.arange(sketches, dtype=np.uint64), np.ones(len(offsets) - 1, bool)))
    monkeypatch.setattr(near_dedup, "KEY_TEXTS", 2)
    monkeypatch.setattr(near_dedup, "PARTNERS", 1)
    rng = random.Random(3)
    a = [f"a{i}" for i in range(100)]
    b = a[:98] + ["b0", "b1"]
    c = [f"c{i}" for i in range(19)] + b[19:]
    others = [[f"o{k}_{i}" for i in range(100)] for k in range(12)]
    texts = [a, b, c] + [t for o in others for t in (o, edited(rng, o, 15))] + [[f"z{i}" for i in range(40)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_classes(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0} | {3 + i: 3 + i - i % 2 for i in range(24)} | {27: 27}


def test_short_texts_are_exact(spark):
    """Every pair of up to 24 words within the bound, whatever its edits."""
    rng, texts, want = random.Random(4), [], {}
    for n in range(5, 25):
        for _ in range(6):
            a = [f"{rng.random()}" for _ in range(n)]
            b = list(a)
            for _ in range(int(0.2 * n + 1e-9)):
                kind, i = rng.random(), rng.randrange(len(b))
                b[i : i + 1] = [f"{rng.random()}"] if kind < 0.6 else []
            want[len(texts)] = want[len(texts) + 1] = len(texts)
            texts += [a, b]
    whole = [f"m{i}" for i in range(10)]
    want |= {len(texts): len(texts), len(texts) + 1: len(texts)}
    texts += [whole, whole[:5] + ["x"] + whole[6:]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_classes(docs).collect()} == want


@pytest.mark.parametrize("n", [30, 60, 200, 600])
def test_recall_near_the_bound(n):
    """Isolated pairs of n words with scattered replacements that share a sketch, by similarity."""
    rng = random.Random(5)
    for share, least in ((0.8, 0.98 if n >= 200 else 0.95), (0.85, 0.99), (0.9, 0.995)):
        texts = []
        for _ in range(300):
            a = [f"{rng.random()}" for _ in range(n)]
            texts += [a, edited(rng, a, round(n * (1 - share)))]
        raw = [" ".join(t).encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
        values, _ = near_dedup.order_minhash(np.frombuffer(b"".join(raw), np.uint8), offsets)
        assert (values[::2] == values[1::2]).any(1).mean() >= least, share


@pytest.mark.parametrize("kept", [1, 3])
def test_number_of_runs_kept(kept):
    """Fewer or more runs a sketch, and as many sketches as the same recall needs."""
    rng = np.random.default_rng(3)
    sketches, met = near_dedup.sketches_for(0.8, 3, 0.95, kept), 0
    for _ in range(100):
        a = rng.integers(0, 1 << 30, 200)
        b = a.copy()
        b[rng.choice(200, 30, replace=False)] += 1
        raw = [" ".join(map(str, x)).encode() for x in (a, b)]
        values, _ = near_dedup.order_minhash(np.frombuffer(b"".join(raw), np.uint8), np.array([0, len(raw[0]), sum(map(len, raw))]), sketches, 3, kept)
        met += bool((values[0] == values[1]).any())
    assert met >= 95


def test_long_texts_take_linear_memory():
    """Forty thousand words, a fifth of them common, a tenth of them other than the text's: exact, in a few megabytes."""
    rng = np.random.default_rng(4)
    a = np.where(rng.random(40_000) < 0.2, rng.integers(0, 50, 40_000), rng.integers(1 << 20, 1 << 40, 40_000)).tolist()
    b = list(a)
    for i in range(0, 40_000, 10):
        b[i] = -i - 1
    tracemalloc.start()
    assert banded_distance(a, b, 8_000) == 4_000
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()


def test_text_of_many_pairs(spark, monkeypatch):
    """One text's pairs dealt into parts; every copy finds it."""
    monkeypatch.setattr(near_dedup, "SPLIT_PAIRS", 7)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if k != i else f"x{i}" for k, w in enumerate(words)), "k") for i in range(100)]
    docs = spark.createDataFrame(rows + [(500, "some other text of its own", "k")], "doc_id long, text string, class_id string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"] > 0) for r in near_classes(docs).collect()}
    assert got == {i: (0, True) for i in range(100)} | {500: (500, False)}


def test_all_pairs_of_the_documents(spark):
    """Every pair of different texts of the 0.01 table by plain dynamic programming: similar ones share a class, and classes hold nothing else."""
    from collections import Counter

    from casefile.llm import queries

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in queries.QUERIES["op2_near_dedup"](spark, sf).collect()}
    first: dict = {}
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        first.setdefault(r["text"] or "", r["doc_id"])
    texts = sorted(((len(w := t.split(" ")), i, w, Counter(w)) for t, i in first.items()), key=lambda t: t[:2])

    def distance(a, b, most):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new, low, high = [i], max(1, i - most), min(len(b), i + most)
            new += [most + 1] * (low - 1)
            for j in range(low, high + 1):
                new.append(min(row[j - 1] + (x != b[j - 1]), (row[j] if j < len(row) else most + 1) + 1, new[-1] + 1))
            row = new + [most + 1] * (len(b) - high)
        return row[-1]

    links = []
    for k, (n, i, a, bag) in enumerate(texts):
        for m, j, b, other in texts[k + 1 :]:
            most = int(0.2 * m + 1e-9)
            if m - n > most:
                break
            if m - sum(min(c, other[w]) for w, c in bag.items() if w in other) <= most and distance(a, b, most) <= most:
                links.append((i, j))
    assert len(links) > 50
    root = {i: i for i in first.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {r["doc_id"]: got[r["doc_id"]][0] for r in docs} == {r["doc_id"]: find(first[r["text"] or ""]) for r in docs}


def test_meetings_of_sorted_groups():
    """Groups that run over batches give the same pairs as a plain double loop, each pair once per batch and split."""
    rng = np.random.default_rng(3)
    rows = sorted((int(g), 0, 0, i, int(rng.integers(60, 90)), i % 3, int(rng.integers(-99, 99)), int(rng.integers(1, 4))) for i in range(120) for g in rng.integers(0, 12, 3))
    g, px, py, ids, n, cls, h, splits = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    n, h, splits, cls = n[ids % len(n)], h[ids % len(h)], splits[ids % len(splits)], cls[ids % len(cls)]
    largest = cls == 0
    bits = pa.ListArray.from_arrays(pa.array(np.arange(len(g) + 1) * (near_dedup.BITS // 64), pa.int32()), pa.array(np.zeros(len(g) * near_dedup.BITS // 64, np.int64)))
    names = ["g", "px", "py", "id", "n", "class", "h", "splits", "largest", "seeks", "sought", "bits"]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, (g, px, py, ids, n, cls, h, splits, largest, ~largest, np.ones(len(g), bool))), bits], names)
    want = {frozenset((int(ids[i]), int(ids[j]))) for i in range(len(g)) for j in range(len(g)) if g[i] == g[j] and cls[i] != cls[j] and abs(n[i] - n[j]) <= int(0.2 * max(n[i], n[j]) + 1e-9) and 2 * max(n[i], n[j]) - n[i] - n[j] <= 2 * int(0.2 * max(n[i], n[j]) + 1e-9)}
    for size in (1, 7, 50, 1000):
        parts = [batch.slice(lo, size) for lo in range(0, len(g), size)]
        got = set()
        for table, begin in near_dedup._whole_groups(iter(parts), ["g", "px", "py"]):
            for out in near_dedup._meetings(table, begin, 0.8):
                got |= {frozenset((r["x"], y)) for r in out.to_pylist() for y in r["ys"]}
        assert got == want and want
    assert not list(near_dedup._whole_groups(iter([]), ["g"]))


def test_large_keys_are_cut_into_cells(spark, monkeypatch):
    """Keys of more texts than a cell takes, and lists in many splits, give the same classes and links."""
    rng = random.Random(5)
    template = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(f"x{rng.random()}" if rng.random() < 0.11 else w for w in template)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, near_classes(docs).collect()))
    met = []
    whole = near_dedup._open_pairs
    monkeypatch.setattr(near_dedup, "_open_pairs", lambda *a: met.append(1) or whole(*a))
    monkeypatch.setattr(near_dedup, "KEY_TEXTS", 4)
    monkeypatch.setattr(near_dedup, "LIST_IDS", 8)
    got = sorted(map(tuple, near_classes(docs).collect()))
    assert got == want and met and len({c for _, c, _ in got}) > 1


def test_texts_are_dealt_once_per_task_and_every_pair_meets():
    """Keys of few and of many texts: each pair with a common key and different classes is found, as by a plain double loop, and a text
    goes to a task once, however many of its keys are there."""
    rng = np.random.default_rng(6)
    h, c = rng.integers(-99, 99, 60), rng.integers(0, 9, 60)
    split = {k: 1 << k % 3 for k in range(30)}
    keys = [sorted(rng.choice(30, 5, replace=False).tolist()) for _ in h]
    bits = [[0] * (near_dedup.BITS // 64)] * 60
    rows = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array([80] * 60, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(c), pa.array(h), pa.array(c == 0), pa.array(keys, pa.list_(pa.int64())), pa.array([[split[k] for k in ks] for ks in keys], pa.list_(pa.int32()))], ["id", "n", "bits", "class", "h", "largest", "keys", "parts"])
    want = {frozenset((i, j)) for i in range(60) for j in range(i) if c[i] != c[j] and set(keys[i]) & set(keys[j])}
    for owners in (1, 40):
        dealt = near_dedup._deal(rows, owners)
        places = list(zip(*[dealt.column(k).to_pylist() for k in ("o", "parts", "px", "py")], strict=True))
        assert len(set(zip(places, dealt.column("id").to_pylist(), strict=True))) == dealt.num_rows
        got = set()
        for place in set(places):
            cell = dealt.filter(pa.array([p == place for p in places]))
            for out in near_dedup._met(cell, 0.8, 3):
                for r in out.to_pylist():
                    pairs = {frozenset(p) for p in zip(r["xs"], r["ys"], strict=True)}
                    assert set(r["ids"]) == {i for p in pairs for i in p}
                    got |= pairs
        assert want and (got == want if owners > 1 else got >= want)
        assert all(c[i] != c[j] for i, j in map(sorted, got))


def test_a_worker_sketches_in_little_memory(spark, monkeypatch):
    made = {}

    def caught(df, f, *rest):
        made[f.__name__] = f
        raise InterruptedError

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", caught)
    with pytest.raises(InterruptedError):
        near_classes(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"))
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, 300)) for _ in range(4000)]
    rows = [pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64())]
    batch = pa.RecordBatch.from_arrays(rows, ["id", "text", "h1", "h2"])
    takes_over("near_dedup")  # what other tests keep in this process goes
    tracemalloc.start()
    # A worker that has encoded texts before: its tokenizer and cached words go when the sketches begin.
    bpe.encode_text(bpe.tokenizer(public_tokenizers.path("word_bpe_49k.json")), " ".join(f"q{x}" for x in range(50_000)))
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    n = sum(part.num_rows for part in made["sketch"](iter([batch])))
    left, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert n == len(texts) and left < held - (16 << 20) and peak < held + (8 << 20), (held, left, peak)


def test_shuffles_go_when_their_result_is_kept(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for name in files.getAllFiles().mkString("\n").split() if "/shuffle_" in name}

    before, setting = shuffled(), spark.conf.get(SHUFFLE_CLEANUP)
    numbers = spark.range(1000).selectExpr("id", "id % 7 as k")
    dealt = cut(numbers.repartition(3, "k"))
    counts = once(dealt.groupBy("k").count()).toArrow()
    for _ in range(100):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting
    assert counts.num_rows == 7 and dealt.count() == 1000 and dealt.groupBy("k").count().count() == 7


def written(spark, since=-1):
    """Bytes that stages after ``since`` wrote to shuffle files, and the last stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    found = [(s.stageId(), s.shuffleWriteBytes()) for s in (stages.apply(i) for i in range(stages.size()))]
    return sum(b for k, b in found if k > since), max(k for k, _ in found)


def mostly_unlike():
    """Ids and texts of 600 words, of which five have a copy with 20 words replaced."""
    rng = random.Random(12)
    texts = [[f"{rng.random()}" for _ in range(600)] for _ in range(200)]
    return list(enumerate(" ".join(t) for t in texts + [edited(rng, t, 20) for t in texts[:5]]))


def test_unlike_texts_are_not_shuffled(spark, monkeypatch):
    """Where ids are too many to be broadcast, texts without a candidate stay where they are, and sketches go once they are read."""
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    rows, threshold = mostly_unlike(), "spark.sql.autoBroadcastJoinThreshold"
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    docs.count()
    cut(spark.range(1))
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    kept_bytes = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)
    disk, last = kept_bytes(), written(spark)[1]
    spark.conf.set(threshold, "-1")  # as if the table were large
    try:
        got = {r["doc_id"]: r["class_id"] for r in near_classes(docs).collect()}
    finally:
        spark.conf.unset(threshold)
    assert got == {i: i - 200 if i >= 200 else i for i, _ in rows}
    assert written(spark, last)[0] < 0.5 * sum(len(t) for _, t in rows)
    assert kept_bytes() - disk < 8 * near_dedup.SKETCHES * len(rows)


def test_among_misses_none(spark):
    ids = spark.range(0, 30_000, 3).select("id")
    test = among(ids, 10_000)
    rows = spark.range(30_000).select("id", test(F.col("id")).alias("may")).collect()
    assert all(r["may"] for r in rows if r["id"] % 3 == 0)
    assert sum(r["may"] for r in rows if r["id"] % 3) < 2_500


def test_fitting_pairs_hold_all_similar_ones(spark):
    rng = random.Random(13)
    a = [[f"{rng.randrange(40)}" for _ in range(n)] for n in (3, 10, 50, 200) for _ in range(10)]
    b = [edited(rng, t, rng.randrange(len(t) // 2 + 1)) for t in a]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(a + b)], "id long, text string")
    pairs = spark.createDataFrame([(i, i + len(a)) for i in range(len(a))], "a long, b long")
    got = {r["a"] for r in near_dedup._fitting(pairs, docs, 0.8).collect()}
    want = {i for i, (x, y) in enumerate(zip(a, b, strict=True)) if distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9)}
    assert want <= got < set(range(len(a))) and want

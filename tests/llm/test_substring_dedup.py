import random
import re

import numpy as np
import pyarrow as pa
import pytest

from casefile.llm import substring_dedup
from casefile.llm.substring_dedup import remove_repeats


def expected(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = {}
    for w in words:
        for i in range(len(w) - window + 1):
            count[tuple(w[i : i + window])] = count.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for (d, _), w in zip(rows, words):
        gone = {i + k for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window, phrase, alphabet", [(5, 2, 3), (7, 3, 12), (35, 6, 400)])
def test_matches_brute_force(spark, window, phrase, alphabet):
    rng = random.Random(window)
    vocabulary = [f"{chr(97 + i % 26)}é{i}"[: 2 + i % 3] + str(i) for i in range(alphabet)]
    passages = [[rng.choice(vocabulary) for _ in range(window + rng.randint(-2, 20))] for _ in range(6)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(docs, window=window, phrase=phrase, shard_bytes=2_000)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()), key=repr) == expected(rows, window)


def test_spans_and_edge_cases(spark):
    p = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None, 0), (2, "", 0), (3, "short text", 0), (4, "a " + p + " b", 0), (5, p, 0), (6, p, 0), (6, p, 0), (None, "\x0b" + p.replace("w7 ", "v7 "), 0), (8, " ".join(["x"] * 60), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = remove_repeats(docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert [(s["from_word"], s["to_word"]) for s in by[4]["spans"]] == [(1, 41)] and by[4]["kept"] == "a b"
    assert by[5]["kept"] == "" and by[8]["n_removed"] == 60 and by[None]["n_removed"] == 0 and by[1]["n_words"] == 0
    assert remove_repeats(docs.limit(0)).count() == 0


def test_words_decide_not_hashes():
    """A passage that was sent removes nothing that does not equal it word by word, nor its own place."""
    p = " ".join(f"w{i}" for i in range(35))
    pieces = substring_dedup._Pieces(pa.table({"name": [1], "from_word": [0], "piece": [p]}), 35, 6)
    for text, want in ((p, 35), (p.replace("w34", "w35"), 0), ("a " + p + " b " + p, 70), (p.replace("w5 ", "w5\u00a0"), 0)):
        gone = np.zeros(len(text.split(" ")), bool)
        pieces.mark(text, 2, gone)
        assert gone.sum() == want
    gone = np.zeros(35, bool)
    pieces.mark(p, 1, gone)
    assert not gone.any()


def test_long_texts(spark):
    """A text of a million words that holds a passage, one word a million times, a word of a million letters."""
    rng = random.Random(5)
    p = " ".join(f"p{i}" for i in range(50))
    long = " ".join(str(rng.random()) for _ in range(500_000)) + " " + p + " end"
    rows = [(1, long), (2, "x " * 100_000), (3, "y" * 1_000_000), (4, p)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (500_051, 50), 2: (100_000, 100_000), 3: (1, 0), 4: (50, 50)}


def test_repetitive_texts_take_linear_time(spark):
    """One word, or a few words, again and again: as many words are marked as brute force marks, in time that follows the text."""
    import time

    took = []
    for n in (4_000, 32_000):
        t = " ".join(["a"] * n)
        pieces = substring_dedup._Pieces(pa.table({"name": [1], "from_word": [0], "piece": [t]}), 35, 6)
        gone = np.zeros(n, bool)
        begun = time.time()
        pieces.mark(t, 1, gone)
        took.append(time.time() - begun)
        assert gone.all()
    assert took[1] < 30 * max(took[0], 0.02)
    rows = [(1, "a " * 300), (2, "a b c " * 90 + "d"), (3, "x " + "b c a " * 60), (4, "a " * 34), (5, " ".join(f"u{i}" for i in range(80)) + " a" * 40), (6, "e f " * 17), (7, "e f " * 18), (8, "a " * 500_000)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()), key=repr) == expected(rows, 35)


def test_passage_of_many_shards(spark):
    """A passage that every shard holds: the ring of shards gives each of them another's place of it."""
    p = " ".join(f"p{i}" for i in range(38))
    rows = [(i, f"{i} q{i} {p} r{i}") for i in range(120)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), shard_bytes=300)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()), key=repr) == expected(rows, 35)

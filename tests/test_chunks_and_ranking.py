import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from casefile import schemas
from casefile.functions import textnorm as X
from casefile.functions import vectors as V
from casefile.operators import chunking as K
from casefile.operators import embedding as E
from casefile.operators import postings as I
from casefile.operators import ranking as R
from casefile.plans.search import search, top_chunks


def test_chunk_lengths(spark):
    text = "".join(chr(97 + i % 26) for i in range(2601))
    for n, count in [(0, 0), (1, 1), (1400, 1), (1401, 2), (2600, 2), (2601, 3)]:
        got = spark.createDataFrame([(text[:n],)], "t string").select(K.chunk_text(F.col("t")).alias("c")).first()["c"]
        assert len(got) == count
        assert "".join([c if i == 0 else c[200:] for i, c in enumerate(got)]) == text[:n]
    with pytest.raises(ValueError):
        K.chunk_text(F.col("t"), 10, 10)


def test_numbering(spark):
    pages = spark.createDataFrame([("a", 1, "x" * 1500), ("a", 2, "y" * 39), ("a", 3, "z" * 40), ("b", 1, "   ")], schemas.PAGES)
    got = K.number_chunks(K.drop_short_chunks(K.chunk_pages(pages))).orderBy("idx").collect()
    assert [(r["decision_id"], r["idx"], r["page"], len(r["text"])) for r in got] == [("a", 0, 1, 1400), ("a", 1, 1, 300), ("a", 2, 3, 40)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(V.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    assert [r[0] for r in df.select(V.decode_vector(V.encode_vector(F.col("v")))).collect()] == [[3.0, 4.0], [0.0, 0.0], None]
    assert bytes(df.select(V.encode_vector(F.col("v"))).first()[0]) == np.array([3, 4], "<f4").tobytes()


def test_embedding_falls_back(spark):
    def make():
        def embed(texts):
            return [[float(len(t))] for t in texts][: 1 if len(texts) > 1 else None]

        return embed

    df = spark.createDataFrame([("a",), ("bb",), ("",), (None,)], "t string").coalesce(1)
    assert [r["vec"] for r in E.embed_column(df, "t", make).collect()] == [[1.0], [2.0], None, None]


@pytest.fixture
def corpus(spark):
    rng = np.random.default_rng(0)
    vec = rng.normal(size=(60, 8)).astype(np.float32)
    chunks = spark.createDataFrame([(str(i // 3), i % 3, 1, f"text {i} άρθρο", vec[i].tolist()) for i in range(60)], schemas.CHUNKS)
    decisions = spark.createDataFrame([(str(i), str(100 + i), "2020", "", "u", "", "", "embedded", 0, 0, None, None) for i in range(20)], schemas.DECISIONS)
    return vec, chunks, decisions


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_topn_is_brute_force(spark, corpus, parts):
    vec, chunks, _ = corpus
    queries = spark.createDataFrame([(q, "t", vec[q * 7].tolist()) for q in range(5)], "query_id long, text string, vec array<float>")
    unit = vec.astype(float) / np.linalg.norm(vec.astype(float), axis=1, keepdims=True)
    got = R.vector_topn(queries, chunks.repartition(parts), 6).collect()
    for q in range(5):
        want = sorted(range(60), key=lambda i: (-round(unit[i] @ unit[q * 7], 12), str(i // 3), i % 3))[:6]
        assert {(r["decision_id"], r["idx"]) for r in got if r["query_id"] == q} == {(str(i // 3), i % 3) for i in want}


def test_blocks_give_the_same(spark, corpus, monkeypatch):
    vec, chunks, decisions = corpus
    queries = spark.createDataFrame([(q, "105", vec[q].tolist()) for q in range(12)], "query_id long, text string, vec array<float>")
    one = sorted(map(tuple, R.rank_chunks(queries, chunks, decisions, 9).collect()))
    monkeypatch.setattr(R, "BLOCK_QUERIES", 3)
    assert sorted(map(tuple, R.rank_chunks(queries, chunks, decisions, 9).collect())) == one


@pytest.mark.parametrize("strip", [7, 1_000_000])
def test_many_queries_stream_past_strips(spark, corpus, monkeypatch, strip):
    vec, chunks, _ = corpus
    queries = spark.createDataFrame([(f"q{q}", "t", vec[q].tolist()) for q in range(30)], "query_id string, text string, vec array<float>")
    # Copies of a vector tie; the smaller decision and place win.
    chunks = chunks.unionByName(chunks.where("decision_id < '5'").withColumn("decision_id", F.concat(F.lit("copy"), "decision_id")))
    one = sorted(map(tuple, R.vector_topn(queries, chunks, 9).collect()))
    targets = queries.select("query_id", F.explode(F.array(F.lit("3"), F.lit("copy3"), F.lit("17"), F.lit("none"))).alias("decision_id"))
    ranks = sorted(map(tuple, R.target_rank(queries, chunks, targets).collect()))
    assert len(one) == 270 and len(ranks) == 90
    for name, value in (("BLOCK_QUERIES", 4), ("STRIP_ROWS", strip), ("SIMS", 50)):
        monkeypatch.setattr(R, name, value)
    assert sorted(map(tuple, R.vector_topn(queries, chunks, 9).collect())) == one
    assert sorted(map(tuple, R.target_rank(queries, chunks, targets).collect())) == ranks
    assert R.vector_topn(queries.limit(0), chunks, 9).count() == 0


def test_token_hits_are_substrings(spark, corpus):
    _, _, decisions = corpus
    texts = ["Η ΑΠΟΦΑΣΗ του Δήμου, αποφάσεις", "", None, "über-Straße 123abc", "the other theme; breathe", "abc123 ab c"]
    chunks = spark.createDataFrame([(str(i), j, 1, t, [1.0]) for i, t in enumerate(texts) for j in range(2)], schemas.CHUNKS)
    asked = spark.createDataFrame([(1, "αποφασ δημ the breath"), (2, "abc 23a tra ber"), (3, "xyz"), (4, "")], "query_id long, text string").select("query_id", X.search_tokens(F.col("text")).alias("tokens"))
    pool = asked.select("query_id").crossJoin(chunks.select("decision_id", "idx"))
    want = pool.join(asked, "query_id").join(chunks, ["decision_id", "idx"]).select("query_id", "decision_id", "idx", R.keyword_hits(F.col("tokens"), X.norm_text(F.coalesce("text", F.lit("")))).alias("hits"))
    got = sorted(map(tuple, I.token_hits(pool, asked, I.as_index(chunks)).collect()))
    assert got == sorted(map(tuple, want.collect())) and {r[3] for r in got} >= {0, 1, 2}


def test_search_reads_texts_of_winners_alone(spark, corpus):
    vec, chunks, decisions = corpus
    queries = spark.createDataFrame([(1, "text 101 αρθρο", vec[0].tolist())], "query_id long, text string, vec array<float>")
    index = I.as_index(chunks)
    read = re.findall(r"ReadSchema: (\S+)", R.rank_chunks(queries, index, decisions, 9)._jdf.queryExecution().executedPlan().toString())
    assert read and not any("text:" in r for r in read)
    assert sorted(map(tuple, search(queries, index, decisions).collect())) == sorted(map(tuple, search(queries, chunks, decisions).collect()))


def test_references_to_a_large_decision_are_sliced(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vec = rng.normal(size=(400, 4)).round(1)
    chunks = spark.createDataFrame([("big", i, 1, "", v.tolist()) for i, v in enumerate(vec)] + [("small", 0, 1, "", [1.0, 0.0, 0.0, 0.0])], schemas.CHUNKS)
    queries = spark.createDataFrame([(q, "t", rng.normal(size=4).tolist()) for q in range(30)], "query_id long, text string, vec array<float>")
    refs = queries.select("query_id", F.lit("big").alias("decision_id")).union(queries.where("query_id < 3").select("query_id", F.lit("small")))
    scored = spark.createDataFrame([(q, "big", i, 0.0, 0.1, False) for q in range(3) for i in range(400)], "query_id long, decision_id string, idx int, sim double, score double, forced boolean")
    one = sorted(map(tuple, R.force_refs(scored, refs, queries, chunks).collect()))
    assert len(one) == 1200 - 3 + 33 and sum(r[5] for r in one) == 33
    monkeypatch.setattr(R, "PAIRS", 50)
    assert sorted(map(tuple, R.force_refs(scored, refs, queries, chunks).collect())) == one


def test_all_similarities_without_a_shuffle(spark, corpus, monkeypatch):
    vec, chunks, _ = corpus
    queries = spark.createDataFrame([(q, "t", v) for q, v in enumerate(vec[:5].tolist() + [[0.0] * vec.shape[1], None])], "query_id long, text string, vec array<float>")
    total = chunks.where("vec is not null").count()
    want = sorted(map(tuple, R.vector_topn(queries, chunks, total).collect()))
    for rows, block in ((1 << 16, R.BLOCK_QUERIES), (7, R.BLOCK_QUERIES), (7, 2)):  # in one piece, in pieces, and queries in several blocks
        monkeypatch.setattr(R, "PAIR_ROWS", rows)
        monkeypatch.setattr(R, "BLOCK_QUERIES", block)
        out = R.similarities(queries, chunks)
        assert len(want) == 6 * total and sorted(map(tuple, out.collect())) == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and (block == 2 or "Exchange" not in plan)


def test_few_forced_entries_leave_scored_ones_where_they_are(spark, monkeypatch):
    """Scored entries are not dealt by key while the forced ones can be broadcast, whatever their estimated size."""
    monkeypatch.setattr(R, "PAIRS", 50)
    chunks = spark.createDataFrame([("big", i, 1, "", [1.0, float(i)]) for i in range(100)], schemas.CHUNKS)
    queries = spark.createDataFrame([(q, "t", [1.0, float(q)]) for q in range(3)], "query_id long, text string, vec array<float>")
    refs = queries.select("query_id", F.lit("big").alias("decision_id"))
    scored = spark.range(100).selectExpr("id % 3 as query_id", "'big' as decision_id", "cast(id as int) as idx", "0.0D as sim", "0.1D as score", "false as forced")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = []
        for most, kind in ((R.BROADCAST_FORCED, "BroadcastHashJoin"), (0, "SortMergeJoin")):
            monkeypatch.setattr(R, "BROADCAST_FORCED", most)
            out = R.force_refs(scored, refs, queries, chunks)
            anti = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftAnti" in x]
            assert anti and all(kind in x for x in anti)
            got.append(sorted(map(tuple, out.collect())))
        assert got[0] == got[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_named_decision_comes_first(spark, corpus):
    vec, chunks, decisions = corpus
    # Not near enough for the pool of five, but on the query's side.
    far = int(np.argsort(-(vec @ vec[0]) / np.linalg.norm(vec, axis=1))[14])
    wanted = str(far // 3)
    queries = spark.createDataFrame([(1, f"see {100 + far // 3}/2020 and {100 + far // 3} / 2020", vec[0].tolist()), (2, "  ", vec[0].tolist())], "query_id long, text string, vec array<float>")
    scored = R.rank_chunks(queries, chunks, decisions, 5)
    forced = scored.where("forced").collect()
    assert len(forced) == 1 and forced[0]["decision_id"] == wanted and abs(forced[0]["score"] - forced[0]["sim"] - 1) < 1e-9
    hits = search(queries, chunks, decisions, k=8).orderBy("rank").collect()
    assert hits[0]["decision_id"] == wanted and len({r["decision_id"] for r in hits}) == len(hits) == 8 and {r["query_id"] for r in hits} == {1}
    assert search(queries, chunks.limit(0), decisions).count() == 0
    assert top_chunks(queries, chunks, decisions, 3).count() == 3


def test_target_rank(spark, corpus):
    vec, chunks, _ = corpus
    queries = spark.createDataFrame([(1, "t", vec[0].tolist())], "query_id long, text string, vec array<float>")
    unit = vec.astype(float) / np.linalg.norm(vec.astype(float), axis=1, keepdims=True)
    sims = unit @ unit[0]
    want = int((sims > sims[15:18].max() + 1e-12).sum()) + 1
    got = R.target_rank(queries, chunks, spark.createDataFrame([(1, "5")], "query_id long, decision_id string")).first()
    assert got["target_rank"] == want


def test_agreement_and_overlap(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id int, vec array<float>")
    b = spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0, 0.0])], "id int, vec array<float>")
    assert tuple(E.vector_agreement(a, b).first()) == (0.5, 0.0)
    x = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "query_id int, decision_id string, rank int")
    y = spark.createDataFrame([(1, "b", 1), (2, "c", 9)], "query_id int, decision_id string, rank int")
    assert E.topk_overlap(x, y, 2).first()["overlap"] == 0.25


def test_topn_leaves_odd_vectors_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 0, [1.0, 0.0]), (None, 0, [1.0, 0.0]), ("b", 0, [nan, 1.0]), ("c", 0, [1.0]), ("d", 0, [inf, 1.0]), ("e", 0, None), ("f", 0, [None, 1.0]), ("g", 0, [0.0, 0.0]), ("h", None, [1.0, 0.0])]
    chunks = spark.createDataFrame(rows, "decision_id string, idx int, vec array<double>")
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (2, [nan, 1.0]), (3, None), (4, [1.0])], "query_id long, vec array<double>")
    got = [(r["query_id"], r["decision_id"]) for r in R.vector_topn(queries, chunks, 9).orderBy(F.desc("sim")).collect()]
    assert got == [(1, "a"), (1, "g")]
    targets = spark.createDataFrame([(1, "g"), (2, "a"), (4, "c")], "query_id long, decision_id string")
    assert [tuple(r) for r in R.target_rank(queries, chunks, targets).collect()] == [(1, "g", 2)]


def test_batches_cross_arrow_batches(spark, tmp_path):
    log = tmp_path / "calls"

    def make():
        def embed(texts):
            with log.open("a") as f:
                f.write(f"{len(texts)}\n")
            return [[float(len(t)), float(sum(map(ord, t)))] for t in texts]

        return embed

    texts = [None if i % 11 == 0 else "" if i % 11 == 1 else "x" * (i % 150) + str(i % 150) for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = E.embed_column(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1), "t", make).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["i"]: r["vec"] for r in got} == {i: [float(len(t)), float(sum(map(ord, t)))] if t else None for i, t in enumerate(texts)}
    calls = list(map(int, log.read_text().split()))
    assert all(n == 64 for n in calls[:-1]) and sum(calls) < len([t for t in texts if t])


def test_equal_texts_of_gone_rows_are_embedded_once(spark, tmp_path):
    log = tmp_path / "texts"

    def make():
        def embed(texts):
            with log.open("a") as f:
                f.write("".join(f"{t}\n" for t in texts))
            return [[float(t)] for t in texts]

        return embed

    rows = [(i, str(i % 90)) for i in range(300)] + [(i, str(i)) for i in range(300, 3000)] + [(3000, "7")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = E.embed_column(spark.createDataFrame(rows, "i int, t string").coalesce(1), "t", make, batch=20).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["i"]: r["vec"] for r in got} == {i: [float(t)] for i, t in rows}
    asked = log.read_text().split()
    assert sorted(asked) == sorted([str(i) for i in [*range(90), *range(300, 3000), 7]])  # 7 had been forgotten


def test_default_embedder(spark):
    import zlib

    texts = ["a b a", "Über ÜBER x", "  ", "word " * 50]
    got = E.embed_column(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    for r in got:
        want = [0.0] * 64
        for w in r["t"].lower().split():
            h = zlib.crc32(w.encode())
            want[h % 64] += 1 if h >= 1 << 31 else -1
        length = sum(x * x for x in want) ** 0.5 or 1
        assert np.allclose(r["vec"], [x / length for x in want], atol=1e-6)

import datetime as dt
import json
import os

import pytest
from pyspark.sql.types import BooleanType, StructField, StructType

from casefile import schemas
from casefile.operators import events as H
from casefile.plans import refresh as P
from casefile.plans import store
from casefile.streaming import jobs

T0 = dt.datetime(2025, 1, 1)


def feed_page(path, *ids, dtype="ΟΡΙΣΤΙΚΗ"):
    path.write_text(json.dumps({"recordsTotal": 9, "data": [[i, dtype, "01/01/2025", f"<a href='http://h/Apofasi-{i}-2025.pdf'>"] for i in ids]}, ensure_ascii=False), encoding="utf-8")


def test_feed_and_refresh(spark, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "root")
    landing.mkdir()
    P.publish(spark.createDataFrame([], schemas.DECISIONS), root, "decisions")
    P.publish(spark.createDataFrame([("1", 0, 1, "old", [1.0]), ("8", 0, 1, "kept", [1.0])], schemas.CHUNKS), root, "chunks")
    feed_page(landing / "1.json", "1", "2")
    pages = spark.createDataFrame([("1", 1, "word " * 400), ("2", 1, "short")], schemas.PAGES)
    run = lambda: jobs.incremental_refresh(spark, str(landing), root, str(tmp_path / "cp"), pages)
    run()
    state = lambda: {r["id"]: (r["status"], r["n_chunks"]) for r in P.current(spark, root, "decisions").collect()}
    assert state() == {"1": ("embedded", 2), "2": ("no_text", 0)}
    texts = sorted((r["decision_id"], r["idx"]) for r in P.current(spark, root, "chunks").collect())
    assert texts == [("1", 0), ("1", 1), ("8", 0)]
    feed_page(landing / "2.json", "1", "3", dtype="ΑΛΛΗ")
    run()
    assert state() == {"1": ("embedded", 2), "2": ("no_text", 0), "3": ("error", 0)}
    run()
    assert state()["1"] == ("embedded", 2) and sorted((r["decision_id"], r["idx"]) for r in P.current(spark, root, "chunks").collect()) == texts


def streamed(spark, tmp_path, rows, schema, job, mode, name):
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = job(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_turns_stream(spark, tmp_path):
    rows = [(t, s, T0 + dt.timedelta(seconds=s), f"{t}.{s} ", None) for s in range(6) for t in (1, 2)]
    last = [(9, 99, T0 + dt.timedelta(hours=1), "later", None)]
    out = streamed(spark, tmp_path, rows + last, schemas.EVENTS, jobs.stream_assemble_turns, "append", "turns")
    got = {r["turn_id"]: r["text"] for r in out.collect()}
    batch = {r["turn_id"]: r["text"] for r in H.assemble_turns(spark.createDataFrame(rows, schemas.EVENTS)).collect()}
    assert got == batch


def test_debounce_stream(spark, tmp_path):
    rows = [(1, i, T0 + dt.timedelta(milliseconds=100 * i if i < 5 else 5000 + 100 * i), f"query{i}") for i in range(9)]
    last = [(1, 99, T0 + dt.timedelta(hours=1), "end of log")]
    out = streamed(spark, tmp_path, rows + last, schemas.KEYSTROKES, jobs.stream_debounce, "append", "queries")
    assert sorted(r["text"] for r in out.collect()) == ["query4", "query8"]


def test_turns_close_at_done(spark, tmp_path):
    """A turn comes out at its done event, once, and stragglers open no new turn; the others wait for silence."""
    schema = StructType([*schemas.EVENTS, StructField("done", BooleanType())])
    at = lambda s: T0 + dt.timedelta(seconds=s)
    first = [(1, 1, at(1), "a", None, None), (1, 0, at(0), "<", "[1]", False), (2, 0, at(0), "only ", None, None)]
    second = [(1, 2, at(2), ">", "[]", None), (1, 3, at(3), None, None, True), (3, 0, at(2), None, "[9]", True)]
    third = [(1, 4, at(4), "late", None, None), (2, 1, at(5), "half", "", None), (4, 0, at(4), "error", None, True)]
    out = streamed(spark, tmp_path, first + second + third, schema, jobs.stream_assemble_turns, "append", "done_turns")
    assert sorted(map(tuple, out.collect())) == [(1, "<a>", "[1]"), (4, "error", None)]


def test_publish_is_old_or_new(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "root")
    with pytest.raises(FileNotFoundError):
        P.current(spark, root, "t")
    for n in range(4):
        P.publish(spark.createDataFrame([(n,)], "n long"), root, "t")
        assert P.current(spark, root, "t").first()["n"] == n
    assert store.vacuum(spark, root) == 0  # readers may hold younger ones
    assert store.vacuum(spark, root, 0) == 6 and P.current(spark, root, "t").first()["n"] == 3
    assert len(list((tmp_path / "root").glob("t-*"))) == 1 and len(list((tmp_path / "root" / "manifests").glob("*.json"))) == 1
    # A draft that was not renamed is no version; a second writer of a version fails.
    (tmp_path / "root" / "manifests" / "draft-x").write_text("{")
    assert P.current(spark, root, "t").first()["n"] == 3
    stale = store.manifest(spark, root) | {"version": 3}
    monkeypatch.setattr(store, "manifest", lambda *_: stale)
    with pytest.raises(RuntimeError):
        store.commit(spark, root, {})


def test_one_commit_for_both_tables(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "root")
    decisions = spark.createDataFrame([(str(i), "1", "2020", "", "u", "", "", "new", 0, 0, None, None) for i in range(4)], schemas.DECISIONS)
    P.publish(decisions, root, "decisions")
    P.publish(spark.createDataFrame([("1", 0, 1, "old", [1.0]), ("8", 0, 1, "kept", [1.0])], schemas.CHUNKS), root, "chunks")
    pages = spark.createDataFrame([(str(i), 1, f"{i} word " * 300) for i in range(3)], schemas.PAGES)
    state = lambda: (sorted((r["id"], r["status"]) for r in P.current(spark, root, "decisions").collect()), sorted((r["decision_id"], r["idx"], r["text"][:3]) for r in P.current(spark, root, "chunks").collect()))
    before = state()
    commit = store.commit

    def dies(*_):
        raise RuntimeError("the driver is lost after both tables are written")

    monkeypatch.setattr(store, "commit", dies)
    with pytest.raises(RuntimeError):
        P.refresh_tables(spark, root, pages)
    assert state() == before
    monkeypatch.setattr(store, "commit", commit)
    P.refresh_tables(spark, root, pages)
    statuses, chunks = state()
    assert statuses == [("0", "embedded"), ("1", "embedded"), ("2", "embedded"), ("3", "error")]
    assert {c[:2] for c in chunks} == {(str(d), i) for d in range(3) for i in range(2)} | {("8", 0)}


def test_replacement_writes_only_its_buckets(spark, tmp_path):
    root = str(tmp_path / "root")
    rows = [(str(i), 0, 1, f"text {i}", [1.0]) for i in range(400)]
    entry = store.bucketed(spark.createDataFrame(rows, schemas.CHUNKS), root, "chunks", "decision_id")
    store.commit(spark, root, {"chunks": entry})
    new = spark.createDataFrame([("7", 0, 1, "new", [2.0]), ("500", 0, 1, "new", [2.0])], schemas.CHUNKS)
    ids = spark.createDataFrame([("7",), ("9",)], "decision_id string")
    after = store.replace_in_buckets(spark, root, "chunks", entry, new, ids)
    store.commit(spark, root, {"chunks": after})
    assert 1 <= sum(after["base"].get(b) != p for b, p in entry["base"].items()) <= 3
    want = {r[0]: r[3] for r in rows if r[0] not in ("7", "9")} | {"7": "new", "500": "new"}
    got = P.current(spark, root, "chunks").collect()
    assert len(got) == len(want) and {r["decision_id"]: r["text"] for r in got} == want
    assert store.replace_in_buckets(spark, root, "chunks", after, new.limit(0), ids.limit(0)) == after


def test_what_batches_write_follows_the_batches(spark, tmp_path, monkeypatch):
    """50 micro-batches of two rows on a table of 20,000: their deltas are small beside the table, and give what one upsert gives."""
    landing, root = tmp_path / "landing", str(tmp_path / "root")
    landing.mkdir()
    base = spark.range(20_000).selectExpr("cast(id as string) id", "md5(cast(id as string)) number", "'2020' year", "'' dtype", "repeat(md5(cast(-id as string)), 4) pdf_url", "'' source_date", "'[]' raw_json", "'embedded' status", "1 text_chars", "1L n_chunks", "cast(null as timestamp) scraped_at", "cast(null as timestamp) ingested_at")
    P.publish(base.coalesce(1), root, "decisions")
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "root").rglob("*.parquet"))
    table = size()
    monkeypatch.setattr(store, "FOLD", 8)
    stream = spark.readStream

    class OneFile:  # a page per micro-batch
        def schema(self, s):
            return stream.schema(s).option("maxFilesPerTrigger", 1)

    monkeypatch.setattr(type(spark), "readStream", property(lambda _: OneFile()))
    for i in range(50):
        feed_page(landing / f"{i:02}.json", str(i), str(30_000 + i % 20), dtype="ΑΛΦΑ" if i % 2 else "ΒΗΤΑ")
        os.utime(landing / f"{i:02}.json", (1_000_000 + i, 1_000_000 + i))
    jobs.stream_feed_upsert(spark, str(landing), root, str(tmp_path / "cp")).awaitTermination()
    now = store.manifest(spark, root)
    assert now["version"] == 51 and len(now["tables"]["decisions"]["deltas"]) < 16
    assert size() - table < 0.4 * table
    assert store.vacuum(spark, root, 0) > 50 and size() - table < 0.1 * table
    got = {r["id"]: (r["dtype"], r["status"]) for r in P.current(spark, root, "decisions").where("dtype != ''").collect()}
    want = {str(i): ("ΑΛΦΑ" if i % 2 else "ΒΗΤΑ", "embedded") for i in range(50)}
    want |= {str(30_000 + j): ("ΑΛΦΑ" if j % 2 else "ΒΗΤΑ", "new") for j in range(20)}
    assert got == want and P.current(spark, root, "decisions").count() == 20_020


def test_last_row_of_the_newest_page_wins(spark, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "root")
    landing.mkdir()
    P.publish(spark.createDataFrame([], schemas.DECISIONS), root, "decisions")
    for name, dtype, when in (("z.json", "ΠΑΛΙΑ", 1_000_000), ("a.json", "ΝΕΑ", 2_000_000)):
        feed_page(landing / name, "1", "1", dtype=dtype)
        os.utime(landing / name, (when, when))
    jobs.stream_feed_upsert(spark, str(landing), root, str(tmp_path / "cp")).awaitTermination()
    assert [r["dtype"] for r in P.current(spark, root, "decisions").collect()] == ["ΝΕΑ"]

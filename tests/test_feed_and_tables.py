import datetime as dt
import json

from pyspark.sql import functions as F

from casefile import schemas
from casefile.operators import feed as P
from casefile.operators import tables as U
from casefile.sources import readers

NOW = dt.datetime(2025, 3, 1)


def decision(id, number="1", year="2020", dtype="", url="", status="new", chars=0, n=0):
    return (id, number, year, dtype, url, "", "[]", status, chars, n, NOW, None)


def rows_of(spark, *rows):
    return spark.createDataFrame(rows, schemas.DECISIONS)


def test_feed(spark, tmp_path):
    cells = [["1", "ΟΡΙΣΤΙΚΗ", "01/02/2025", "<a href='http://h/Apofasi-A5-2025.pdf'>x</a>", None], ["2", "none"], ["3", "Οριστική ", "ABC", "<A HREF='http://h/b.PDF?x'>"], ["4", "href='c.pdf'"]]
    (tmp_path / "1.json").write_text(json.dumps({"recordsTotal": 9, "data": cells}), encoding="utf-8")
    (tmp_path / "2.json").write_text(json.dumps({"recordsTotal": 9, "data": []}))
    feed = readers.read_feed(spark, str(tmp_path))
    got = {r["id"]: r for r in P.parse_feed_rows(feed).collect()}
    assert set(got) == {"1", "3", "4"}
    assert (got["1"]["number"], got["1"]["year"], got["1"]["dtype"], got["1"]["source_date"]) == ("A5", "2025", "ΟΡΙΣΤΙΚΗ", "01/02/2025")
    assert json.loads(got["1"]["raw_json"]) == ["1", "ΟΡΙΣΤΙΚΗ", "01/02/2025", cells[0][3], ""]
    assert got["3"]["dtype"] == "" and got["4"]["source_date"] == "" and got["3"]["pdf_url"] == "http://h/b.PDF?x"
    assert tuple(P.feed_tallies(feed).first()) == (3, 1, 9)


def test_fetches_and_collisions(spark):
    candidates = spark.createDataFrame([("a", ["u1", "u2"]), ("b", ["u3", "u4"]), ("c", ["u5"])], "id string, urls array<string>")
    log = spark.createDataFrame([("u1", False, "e1"), ("u2", True, None), ("u3", False, "e3"), ("u4", False, "e4")], "url string, ok boolean, error string")
    assert sorted(map(tuple, P.resolve_fetches(candidates, log).collect())) == [("a", "u2", None), ("b", None, "e4"), ("c", None, None)]
    d = rows_of(spark, decision("1", url="h/Apofasi--.pdf"), decision("2", url="g/Apofasi--.pdf"), decision("3", url="h/x.pdf"))
    assert {r["id"] for r in P.file_name_collisions(d).collect()} == {"1", "2"}


def test_repair_is_idempotent(spark):
    d = rows_of(spark, decision("1", "", "", url="Apofasi-A7-2021.pdf"), decision("2", None, None, url="Apofasi-8-2021.pdf"), decision("3", "5", "2020", url="scan.pdf"), decision("4", "9", "2021", url="Apofasi-9-2021.pdf"))
    once = P.repair_numbers(d)
    assert {r["id"]: (r["number"], r["changed"]) for r in once.collect()} == {"1": ("A7", True), "2": ("8", True), "3": ("5", False), "4": ("9", False)}
    assert P.repair_numbers(once.drop("changed")).where("changed").count() == 0


def test_upsert(spark):
    old = rows_of(spark, decision("1", status="embedded", chars=900, n=3), decision("2"))
    come = spark.createDataFrame([("1", "1", "2020", "first", "u", "", "[]", NOW, 0), ("1", "1", "2020", "last", "u", "", "[]", NOW, 1), ("3", "3", "2024", "", "u", "", "[]", NOW, 0)], "id string, number string, year string, dtype string, pdf_url string, source_date string, raw_json string, scraped_at timestamp, at int")
    new = U.upsert_decisions(old, come, "at")
    got = {r["id"]: (r["dtype"], r["status"], r["text_chars"], r["n_chunks"]) for r in new.collect()}
    assert got == {"1": ("last", "embedded", 900, 3), "2": ("", "new", 0, 0), "3": ("", "new", 0, 0)}
    assert new.schema.simpleString() == old.schema.simpleString()
    assert sorted(map(tuple, U.upsert_decisions(new, come, "at").collect())) == sorted(map(tuple, new.collect()))


def test_pending(spark):
    d = rows_of(spark, decision("1", "10", "2025"), decision("2", "9", "2025", status="error"), decision("3", "A831", "2025"), decision("4", "5", ""), decision("5", "7", "2025", status="embedded"), decision("6", "1", "2025", status="no_text"))
    assert [r["id"] for r in U.select_pending(d).collect()] == ["1", "2", "3", "4"]
    assert [r["id"] for r in U.select_pending(d, min_year=2024, limit=2).collect()] == ["1", "2"]
    assert [r["id"] for r in U.select_pending(d, year="2025", min_year=0).collect()] == ["1", "2", "3"]
    assert {r["id"] for r in U.remaining_work(d).collect()} == {"1", "2", "3", "4"}
    assert U.recent_min_year(dt.datetime(2026, 1, 1)) == 2025


def test_status_and_outcomes(spark):
    pages = spark.createDataFrame([("a", 1, "x" * 150), ("a", 2, " " * 49), ("b", 1, "y" * 200), ("c", 1, None)], schemas.PAGES)
    chunks = spark.createDataFrame([("a", 0, 1, "t", None), ("b", 0, 1, "t", None), ("b", 1, 1, "t", None)], schemas.CHUNKS)
    out = U.classify_documents(pages, chunks)
    assert sorted(map(tuple, out.collect()))[:2] == [("a", "no_text", 199, 0), ("b", "embedded", 200, 2)]
    d = rows_of(spark, decision("a"), decision("b", status="embedded", chars=5, n=1), decision("z"))
    outcomes = spark.createDataFrame([("a", "embedded", 300, 2), ("b", "error", None, None)], "id string, status string, text_chars long, n_chunks long")
    got = {r["id"]: (r["status"], r["text_chars"], r["n_chunks"], r["ingested_at"] is not None) for r in U.apply_outcomes(d, outcomes).collect()}
    assert got == {"a": ("embedded", 300, 2, True), "b": ("error", 5, 1, False), "z": ("new", 0, 0, False)}
    assert {(r["status"], r["n_decisions"], r["n_chunks"]) for r in U.corpus_stats(d, chunks).collect()} == {("new", 2, 1), ("embedded", 1, 2), (None, 3, 3)}
    new = spark.createDataFrame([("b", 0, 1, "new", None)], schemas.CHUNKS)
    assert sorted((r["decision_id"], r["text"]) for r in U.replace_chunks(chunks, new, spark.createDataFrame([("b",)], "decision_id string")).collect()) == [("a", "t"), ("b", "new")]


def test_documents_and_pages(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.pdf").write_bytes("one\ftwo".encode())
    (tmp_path / "d" / "b.txt").write_bytes(b"no")
    docs = readers.read_documents(spark, str(tmp_path / "d"))
    assert [(r["file_name"], bytes(r["content"])) for r in docs.collect()] == [("a.pdf", b"one\ftwo")]
    pages = readers.extract_pages(docs, key="file_name")
    assert sorted(map(tuple, pages.collect())) == [("a.pdf", 1, "one"), ("a.pdf", 2, "two")]

    def failing(content):
        return ["ok", lambda: 1 / 0, lambda: "three"]

    assert [r["text"] for r in readers.extract_pages(docs, failing, "file_name").orderBy("page").collect()] == ["ok", "", "three"]
    assert [r["text"] for r in readers.extract_pages(docs, lambda c: 1 / 0, "file_name").collect()] == [""]


def test_tables_and_results(spark, tmp_path):
    rows_of(spark, decision("1")).write.parquet(str(tmp_path / "decisions"))
    spark.createDataFrame([("1", 0, 1, "t", [1.0])], schemas.CHUNKS).write.parquet(str(tmp_path / "chunks"))
    d, c = readers.read_tables(spark, str(tmp_path))
    assert d.count() == c.count() == 1
    hits = spark.createDataFrame([("q", 2, "2", "2020", "", "u", 0.5, "s", "t"), ("q", 1, "1", "2020", "", "u", 0.7, "ά", "t")], "query string, rank int, number string, year string, type string, pdf_url string, score double, snippet string, title string")
    readers.write_results(hits, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part*.json")).read_text(encoding="utf-8")
    assert "ά" in text and [r["number"] for r in json.loads(text)["results"]] == ["1", "2"]
    assert F is not None

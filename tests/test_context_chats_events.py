import datetime as dt

from pyspark.sql import functions as F

from casefile import schemas
from casefile.operators import chats as C
from casefile.operators import context as G
from casefile.operators import events as H

T0 = dt.datetime(2025, 1, 1)


def messages(spark, *rows):
    return spark.createDataFrame([(i, c, role, text, src, T0 + dt.timedelta(seconds=i)) for i, c, role, text, src in rows], schemas.MESSAGES)


def test_history(spark):
    m = messages(spark, *[(i, 1, "user" if i % 2 else "system", f"{i}" * 600, None) for i in range(1, 9)])
    got = {r["id"]: r["history"].split("\n") if r["history"] else [] for r in G.history_window(m).collect()}
    assert got[1] == [] and got[8] == [f"{'Χρήστης' if i % 2 else 'Βοηθός'}: {str(i) * 500}" for i in range(2, 8)]
    prompts = {r["id"]: r["prompt"] for r in G.followup_prompt(m).collect()}
    assert prompts[1] == "1" * 600 and prompts[8].count("\n") == 6 and "Χρήστης: " + "7" * 300 + "\n" in prompts[8]


def test_effective_query(spark):
    rows = [("q", False, "r", None), ("q", False, "r", " s\nx "), ("q", True, None, "s"), ("q", True, "", "s"), ("q", True, " one \ntwo", "s")]
    df = spark.createDataFrame(rows, "q string, f boolean, r string, s string")
    pick = lambda **o: [r[0] for r in df.select(G.effective_query(F.col("q"), F.col("f"), F.col("r"), F.col("s"), **o)).collect()]
    assert pick() == ["q", "s", "q", "q", "one"]
    assert pick(first_line=False) == ["q", "s\nx", "q", "q", "one \ntwo"]


def test_prompts_and_sources(spark):
    hit = "query_id long, rank int, number string, year string, type string, pdf_url string, title string, text string"
    hits = spark.createDataFrame([(1, 2, "5", "2020", "", "u5", "t5", "b" * 1300), (1, 1, "4", "2020", "T", "u4", "t4", "a"), (1, 3, "4", "2020", "T", "u4b", "t4", "c")], hit)
    questions = spark.createDataFrame([(1, "why"), (2, "how")], "query_id long, question string")
    got = {r["query_id"]: r["context"] for r in G.context_blocks(questions, hits).collect()}
    assert got[1] == "[4/2020] (T)\na\n\n---\n\n[5/2020] ()\n" + "b" * 1200 + "\n\n---\n\n[4/2020] (T)\nc" and got[2] == G.NO_CONTEXT
    history = spark.createDataFrame([(1, "Χρήστης: x"), (2, "")], "query_id long, history string")
    prompts = {r["query_id"]: r["prompt"] for r in G.grounded_prompts(questions, hits, history, "SYS").collect()}
    assert prompts[2] == f"SYS\n\n{G.EXCERPTS_HEAD}\n{G.NO_CONTEXT}\n\n{G.QUESTION_HEAD}\nhow\n\n{G.ANSWER_HEAD}"
    assert prompts[1].startswith(f"SYS\n\n{G.HISTORY_HEAD}\nΧρήστης: x\n\n{G.EXCERPTS_HEAD}\n[4/2020]")
    sources = G.dedupe_sources(hits)
    assert [s["pdf_url"] for s in sources.first()["sources"]] == ["u4", "u5"]
    assert sources.select(G.citation_line(F.col("sources"))).first()[0] == "[4/2020](u4)  ·  [5/2020](u5)"


def chat_rows(spark):
    return spark.createDataFrame([(1, "a", "ann", T0, T0), (2, "b", "bob", T0, T0 + dt.timedelta(1)), (3, "c", None, T0, T0), (4, "d", "ann", T0, T0 + dt.timedelta(2)), (5, "e", "", T0, T0)], schemas.CHATS)


def test_ownership(spark):
    chats = chat_rows(spark)
    m = messages(spark, (1, 1, "user", "x", None), (2, 1, "assistant", "y", None))
    owners = spark.createDataFrame([("ann",), (None,), ("",)], "owner string")
    assert [(r["id"], r["n_messages"]) for r in C.list_chats(chats, m, owners).collect()] == [(4, 0), (1, 2)]
    assert C.list_chats(chats, m, owners.limit(1), shared=True).count() == 5
    asks = spark.createDataFrame([(1, 1, "ann"), (2, 1, "bob"), (3, 3, None), (4, 5, ""), (5, 9, "ann"), (6, 2, "bob")], "ask_id long, chat_id long, owner string")
    assert {r["ask_id"] for r in C.owned(asks, chats).collect()} == {1, 6}
    assert {r["ask_id"] for r in C.owned(asks, chats, shared=True).collect()} == {1, 2, 3, 4, 6}
    assert {r["ask_id"]: r["target"] for r in C.route_asks(asks, chats).collect()} == {1: "1", 2: "new-2", 3: "new-3", 4: "new-4", 5: "new-5", 6: "2"}
    left, kept, told = C.delete_chats(chats, m, asks.where("ask_id in (1, 2, 3)"))
    assert {r["id"] for r in left.collect()} == {2, 3, 4, 5} and kept.count() == 0
    assert {r["ask_id"]: r["ok"] for r in told.collect()} == {1: True, 2: False, 3: False}
    _, kept, _ = C.delete_chats(chats, m, asks.where("ask_id = 2"))
    assert kept.count() == 2


def test_transcript_titles_append(spark):
    chats = chat_rows(spark)
    m = messages(spark, (3, 1, "user", "later", None), (1, 1, "user", "f" * 90, ""), (2, 1, "assistant", "y", '[{"number":"7","year":"2020"}]'), (4, 1, "assistant", "z", "broken ["), (9, 2, "user", "w", None))
    asks = spark.createDataFrame([(1, "ann"), (2, "ann")], "chat_id long, owner string")
    got = C.chat_transcript(m, asks, chats).collect()
    assert [r["id"] for r in got] == [1, 2, 3, 4] and got[0]["sources"] is None and got[1]["sources"][0]["number"] == "7" and got[3]["sources"] == []
    assert {r["chat_id"]: r["title"] for r in C.chat_titles(m).collect()} == {1: "f" * 60, 2: "w"}
    new = messages(spark, (700, 2, "user", "n", None))
    moved, everything = C.append_messages(chats, m, new)
    assert {r["id"]: r["updated_at"] for r in moved.collect()}[2] == T0 + dt.timedelta(seconds=700) and everything.count() == 6
    assert {r["owner"] for r in C.with_owner(chats.drop("owner")).collect()} == {None}


def test_token_lines(spark):
    def parsed(dialect, *lines):
        df = spark.createDataFrame([(1, i, T0, line) for i, line in enumerate(lines)], schemas.TOKEN_LINES)
        return [r["token"] for r in H.parse_token_lines(df, dialect).orderBy("seq").collect()]

    assert parsed("openai", 'data: {"choices":[{"delta":{"content":"a"}}]}', ": ping", "data:", "data: [DONE]", "data: {bad", 'data: {"choices":[]}', 'data:{"choices":[{"delta":{"content":"b"}}]}') == ["a", "b"]
    assert parsed("gemini", 'data: {"candidates":[{"content":{"parts":[{"text":"a"},{"text":"b"}]}}]}', "data: {}", "x") == ["ab"]
    assert parsed("ndjson", '{"message":{"content":"a"},"done":false}', "bad", '{"message":{"content":"b"},"done":true}', '{"message":{"content":"c"},"done":false}') == ["a", "b"]


def test_turns(spark):
    rows = [(1, 2, T0, "b", "[]"), (1, 1, T0, "a", '["x"]'), (2, 1, T0, None, '["y"]'), (3, 1, T0, "c", None)]
    got = {r["turn_id"]: (r["text"], r["sources"]) for r in H.assemble_turns(spark.createDataFrame(rows, schemas.EVENTS)).collect()}
    assert got == {1: ("ab", '["x"]'), 3: ("c", None)}


def test_debounce(spark):
    at, rows = T0, []
    for i, (gap, text) in enumerate([(0, "a"), (100, "ab"), (349, " abc "), (351, "d"), (351, "de")]):
        at += dt.timedelta(milliseconds=gap)
        rows.append((1, i, at, text))
    got = [r["text"] for r in H.debounce_queries(spark.createDataFrame(rows, schemas.KEYSTROKES)).orderBy("settled_at").collect()]
    assert got == ["abc", "de"]


def test_long_turns_are_put_together_in_pieces(spark):
    rows = [(1, s, f"t{s} ", "[1]" if s == 40 else "[]" if s == 90 else None) for s in range(-7, 100)] + [(1, 55, None, "[2]"), (2, 0, None, "[3]"), (3, 5, "", None), (3, 7, "b", None), (3, -9, "a", None)]
    events = spark.createDataFrame(rows, "turn_id long, seq long, token string, sources string").repartition(5)
    want = [(1, "".join(f"t{s} " for s in range(-7, 100)), "[2]"), (3, "ab", None)]
    for span in (1, 4, 1_000):
        assert sorted(map(tuple, H.assemble_turns(events, span).collect())) == want

import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from casefile.llm import token_files as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(texts):
    tok = Tokenizer.from_file(PATH)
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]


def test_round_trip(spark, tmp_path):
    odd = ["", None, " lead", "trail ", "two  spaces", "a\n\nb", "line\nbreak it's 12 o'clock", "tab\there", "nbsp x y", "x <|endoftext|> y", "é ñ\n日本 語", "\x01 mark", "a \nb", "can't\n'll  !!! ??", "🙂 👩‍👩‍👧 ok", "ends. here, and… so…, x., é, 3. n't. a,b c.,", "one, two,\nthree.\nfour", "w " * 3000, " a b", "a b c"]
    rows = [(1000 - i, odd[i % len(odd)] if i < 66 else f"text number {i} of\nmany {i * 7919 % 1000}", "s") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    folder = str(tmp_path / "tokens")
    tf.write_tokens(docs, folder, PATH, metadata=("source",))
    tokens = tf.read_tokens(spark, folder)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tf.token_offsets(tokens).collect()}
    rows.sort()
    start, want = 0, {}
    for (i, *_), ids in zip(rows, ids_of([t for _, t, _ in rows])):
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want
    assert {r["doc_id"]: list(r["tokens"]) for r in tokens.collect()}[1000] == [2]
    file = next((tmp_path / "tokens").glob("part-*.parquet"))
    column = pq.ParquetFile(file).metadata.row_group(0)
    by = {column.column(i).path_in_schema: column.column(i) for i in range(column.num_columns)}
    assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(by["tokens.list.element"].encodings) and by["doc_id"].has_offset_index and by["doc_id"].has_column_index


def test_edge_cases(spark, tmp_path):
    rows = [(None, "a"), (1, "b"), (1, "b"), (1, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "tokens").selectExpr("doc_id", "tokens as text", "1 as tokens")
    folder = str(tmp_path / "t")
    tf.write_tokens(docs, folder, PATH)
    got = tf.token_offsets(tf.read_tokens(spark, folder)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, 1] and [r["start"] for r in got] == [0, 2, 4, 6]
    tf.write_tokens(docs.limit(0), str(tmp_path / "e"), PATH)
    assert tf.token_offsets(tf.read_tokens(spark, str(tmp_path / "e"))).count() == 0


def test_table_forgets(monkeypatch):
    """Ids stay right when parts are dropped from the table and come again."""
    monkeypatch.setattr(tf, "CACHE", 50)
    tok, enc = Tokenizer.from_file(PATH), tf._Encoder(PATH)
    texts = [" ".join(f"{'abcdefgh'[j % 8]}{'xyz' * (j % 5)}{k * j % 97}" if j % 3 else "word" * (1 + k * j % 9) for j in range(60)) for k in range(40)]
    for _ in range(2):
        for lo in range(0, 40, 4):
            some = [t.encode() for t in texts[lo : lo + 4]]
            got = enc.encode(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in some])]))
            assert [x.tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts[lo : lo + 4]]


def test_reads_only_pages_of_the_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "PAGE_ROWS", 100)
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('text ', id) as text").coalesce(1)
    tf.write_tokens(docs, str(tmp_path / "t"), PATH)
    some = tf.read_tokens(spark, str(tmp_path / "t"), ids=[7, 4321], columns=("doc_id", "n_tokens"))
    assert sorted(r["doc_id"] for r in some.collect()) == [7, 4321] and some.columns == ["doc_id", "n_tokens", "file", "row"]
    plan = some._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    read = scan.metrics().apply("numOutputRows").value()
    assert 0 < read < 1000, read
    assert "tokens" not in scan.simpleString(1000).split("ReadSchema:")[1].replace("n_tokens", "")


def test_files_are_ordered_by_number(spark):
    rows = [(i, f"part-{n}-x.parquet", 0, [1] * (i + 1)) for i, n in enumerate(("99998", "99999", "100000", "100001"))]
    tokens = spark.createDataFrame(rows, "doc_id long, file string, row long, tokens array<int>")
    assert [r["start"] for r in tf.token_offsets(tokens).orderBy("doc_id").collect()] == [0, 1, 3, 6]


def test_distinct_values():
    """As NumPy's, but for which of equal values' places is given."""
    values = np.random.default_rng(1).integers(0, 50, 1000).astype(np.uint64)
    key, place, which = tf._distinct(values)
    assert (key == np.unique(values)).all() and (values[place] == key).all() and (key[which] == values).all()
    assert all(len(x) == 0 for x in tf._distinct(values[:0]))


def test_punctuation_after_letters_is_looked_up(monkeypatch):
    encoder, rng, asked = tf._Encoder(public_tokenizers.path("byte_bpe_50k.json")), np.random.default_rng(3), []
    monkeypatch.setattr(tf, "MARKS_KEPT", 5)
    parts = [" word###", "étude***", " word,***", "don't", "it's,", "x'", "12,", "--", " é"] + sorted({"".join(rng.choice(list("abéß1'.,#*-%"), rng.integers(1, 7))) for _ in range(2000)})
    whole = encoder.whole
    monkeypatch.setattr(encoder, "whole", lambda text: asked.append(text) or whole(text))
    size, ids = encoder.parts([p.encode() for p in parts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [encoder.tok.encode(p, add_special_tokens=False).ids for p in parts]
    assert not any("word" in text or "étude" in text for text in asked) and len(encoder.marks) <= 5
    size, ids = encoder.parts([b"ab##"])
    assert ids.tolist() == encoder.tok.encode("ab##", add_special_tokens=False).ids

import random

from casefile.llm import line_dedup
from casefile.llm.line_dedup import dedup_lines


def near(a, b):
    """Within one edit, by trying them all."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, similarity):
    lines = sorted((i, n, line.strip(" ")) for i, t in rows for n, line in enumerate((t or "").split("\n")) if t is not None)
    seen, gone = [], set()
    for i, n, line in lines:
        if line:
            if any(line == s or (1 - 1 / max(len(line), len(s)) >= similarity - 1e-9 and near(line, s)) for s in seen):
                gone.add((i, n))
            seen.append(line)
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def test_matches_brute_force(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(1, 24))) for _ in range(30)]

    def change(line):
        i = rng.randrange(len(line) + 1)
        return rng.choice([line, line[:i] + "x" + line[i:], line[:i] + line[i + 1 :], line[:i] + "y" + line[i + 1 :], ""])

    rows = [(i, "\n".join(change(rng.choice(base)) for _ in range(rng.randint(1, 6)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for similarity in (0.5, 0.8, 0.9):
        got = {r["doc_id"]: r["text"] for r in dedup_lines(docs, similarity=similarity).collect()}
        assert got == expected(rows, similarity)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    rows = [(i, f"shared beginning of line {i % 40}\nshared beginning of line {'abcdefgh'[i % 8]}x{i % 3}") for i in range(80)]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected(rows, 0.8)


def test_long_lines_and_chains(spark):
    a = "word " * 400 + "end"
    b, c = a[:700] + "X" + a[701:], a[:700] + "X" + a[701:900] + "Y" + a[901:]
    docs = spark.createDataFrame([(1, a), (2, b), (3, c), (4, a + "zz")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in dedup_lines(docs).collect()}
    # 3 is near 2, which goes itself: judged on the input. 4 is two edits away.
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


def test_edge_cases(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "\n\n", "k"), (4, "same", "k"), (4, "same", "k"), (None, "same", "k"), (5, "ß\nß", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string").withColumnRenamed("n_lines", "n_removed")
    out = dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "n_removed", "n_lines", "_n_removed"]
    got = sorted(((r[0], r[1], r[3], r[4]) for r in out.collect()), key=repr)
    assert got == sorted([(1, None, 0, 0), (2, "", 1, 0), (3, "\n\n", 3, 0), (4, "", 1, 1), (4, "", 1, 1), (None, "same", 1, 0), (5, "ß", 2, 1)], key=repr)
    assert dedup_lines(docs.limit(0)).count() == 0

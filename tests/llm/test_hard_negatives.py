import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from casefile.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=5):
    """Exact results in Python's integers; rows are (vec_id, vector, label)."""
    fine = [(i, [int(c) * 256 if abs(c) > 1e300 else math.floor(256 * c) for c in v], lab) for i, v, lab in rows if i is not None and lab is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, (a, av, al) in enumerate(fine):
        if a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(av, v)), i, lab) for m, (i, v, lab) in enumerate(fine) if m != n]
        scored = sorted((x for x in scored if abs(x[0]) < 1 << 63), key=lambda x: (-x[0], x[1]))
        for p, pid, _ in [x for x in scored if x[2] == al][:k]:
            hard = [x for x in scored if x[2] != al and 80 * p <= 100 * x[0] <= 100 * p][:k]
            out += [(a, pid, r, i, p, s) for r, (s, i, _) in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, H.mine(df, F.col("vec_id") % 100 == 0, **kw).collect()))


@pytest.mark.parametrize("scale", [1, 1e-3, 40, 1e7, 1e9])
def test_products_are_exact(scale):
    rng = np.random.default_rng(3)
    a, r = (np.floor(256 * scale * rng.normal(size=(n, 7))) for n in (5, 131))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in r] for p in a]
    assert H.packed_products(a, r).tolist() == want
    assert H.packed_products(a.astype(int).astype(object), r).tolist() == want


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 9))
    rows = [(int(i), (centres[i % 6] + 0.4 * rng.normal(size=9)).tolist(), int(rng.choice([0, 0, 0, 1, 2, 3]))) for i in range(900)]
    got = mined(spark, rows)
    assert len(got) > 100 and got == brute(rows)


def test_strips_and_parts_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(int(i) * 50, rng.normal(size=4).tolist(), int(i % 3)) for i in range(300)]
    want = brute(rows)
    for name, value in (("STRIP_ROWS", 40), ("PART_ANCHORS", 7), ("LEAST_STRIP", 8), ("SCORES", 50)):
        monkeypatch.setattr(H, name, value)
    assert mined(spark, rows) == want


def test_odd_rows(spark):
    inf, nan = math.inf, math.nan
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.9], 2), (2, [1.0, 1.9], 2), (3, [1.0, 1.9], 2), (4, [1.0, 1.95], 3),
            (5, None, 1), (6, [], 1), (7, [1.0, None], 1), (8, [inf, 1.0], 2), (9, [nan, 1.0], 2), (10, [1.0, 1.0], None), (None, [1.0, 2.0], 1),
            (100, [-1.0, -2.0], 2), (200, [0.0, 0.0], 4), (300, [0.5, 1.0], 4), (11, [0.0, 0.0], 4)]
    want = brute(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows + [(12, [1.0, 2.0, 3.0], 1)]) == want  # another width than most
    assert mined(spark, []) == []
    assert mined(spark, [(0, None, 1)]) == []


def test_large_and_tiny_components(spark):
    rows = [(100 * i, [s * 1e7, 1e3 + i, -3e-9], i % 2) for i, s in enumerate((1.0, 0.999, 0.99, 1.001, 1e-3, 1e-18))]
    assert brute(rows) and mined(spark, rows) == brute(rows)
    huge = rows + [(1000, [1e308, 1.0, 1.0], 0), (1001, [-1e307, 1.0, 2.0], 1), (1002, [1e-300, 0.0, 0.0], 1)]
    assert mined(spark, huge) == brute(huge)


def test_extra_columns_with_clashing_names(spark):
    rows = [(i, [1.0 + i % 5, 2.0], i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.withColumns({c: F.lit("x") for c in ("id", "row", "v", "own", "strip", "part", "rank", "asks", "w", "score")})
    assert sorted(map(tuple, H.mine(clash, F.col("vec_id") % 100 == 0).collect())) == brute(rows)


def test_one_label_alone_has_no_negatives(spark):
    assert mined(spark, [(i, [1.0, float(i % 3)], 1) for i in range(150)]) == []

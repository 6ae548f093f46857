"""Hard-negative mining against brute force."""

import numpy as np
from pyspark.sql import functions as F

from chartmill.llm.hard_negatives import cells_in_order, fit_codes, mine_hard_negatives

ROWS = "vec_id bigint, label int, vector array<double>, anchor bigint, cell int, row string, score double"


def brute(rows, chosen, positives=5, negatives=5):
    used = [(i, c, [*v, *[0.0] * 16]) for i, c, v in rows if i is not None and c is not None and v is not None]
    out = []
    for i, c, v in used:
        if not chosen(i):
            continue
        scores = sorted((-int(sum(a * b for a, b in zip(v, w))), j, d) for j, d, w in used if j != i)
        for s, j, _ in [x for x in scores if x[2] == c][:positives]:
            inside = [(n, m) for n, m, d in scores if d != c and 80 * -s <= 100 * -n <= 100 * -s]
            out += [(i, j, rank, m, -s, -n) for rank, (n, m) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **sizes):
    frame = spark.createDataFrame([(i, c, v, 1, 2, "x", 3.0) for i, c, v in rows], ROWS)
    return sorted(tuple(r) for r in mine_hard_negatives(frame, F.col("vec_id") % 10 == 0, **sizes).collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(6, 7)) * 60
    rows = [(i, int(rng.integers(3)), np.floor(centers[i % 6] + rng.normal(size=7) * 20).tolist()) for i in range(240)]
    rows += [(1000 + k, k % 3, rows[7][2]) for k in range(80)]  # one vector very often: ties, and a cell of many pages
    rows += [(2000, None, [1.0]), (2010, 0, None), (None, 0, [1.0] * 7), (2020, 1, []), (2030, 2, [5.0, -3.0]), (2040, 9, [50.0] * 7), (2050, 0, [0.0] * 7)]
    rows += [(30, 1, rows[30][2]), (20, rows[20][1], rows[20][2])]  # repeated ids
    got = mined(spark, rows, cell_rows=8, page_rows=16, first_rows=20, anchor_block=7)
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 300


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(10, 1, [2.0])]) == []
    rows = [(10, 1, [10.0, 0.0]), (11, 1, [9.0, 0.0]), (12, 2, [9.0, 1.0]), (13, 2, [8.0, 0.0]), (14, 2, [7.0, 0.0]), (15, 2, [9.5, 0.0])]
    assert mined(spark, rows) == [(10, 11, 1, 12, 90, 90), (10, 11, 2, 13, 90, 80)] == brute(rows, lambda i: i % 10 == 0)


def test_cells_come_by_falling_bound():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=9), rng.normal(size=5)
    walked = list(cells_in_order(a, b))
    assert len({(i, j) for _, i, j in walked}) == 45 and [x for x, _, _ in walked] == sorted((x for x, _, _ in walked), reverse=True)
    assert all(x == a[i] + b[j] for x, i, j in walked)


def test_codes_of_few_points():
    assert fit_codes(np.zeros((0, 3)), 4).shape == (1, 3)
    assert len(fit_codes(np.ones((9, 3)), 4)) == 1

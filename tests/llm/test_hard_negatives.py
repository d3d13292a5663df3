import random

import numpy as np
from pyspark.sql import functions as F

from varve.llm import hard_negatives as hn


def brute(rows, is_anchor, n_pos=5, n_neg=3):
    """rows: vec_id, label, whole numbers; each once."""
    out = []
    for a_id, a_label, a in rows:
        if not is_anchor(a_id):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a, v)), i, label) for i, label, v in rows if i != a_id))
        for s, p, label in [r for r in scored if r[2] == a_label][:n_pos]:
            found = [(i, n) for n, i, other in scored if other != a_label and 50 * s >= 100 * n >= 95 * s]
            out += [(a_id, p, k, i, -s, -n) for k, (i, n) in enumerate(found[:n_neg], 1)]
    return sorted(out)


def mined(df, anchors="vec_id % 3 = 0", **more):
    return sorted(tuple(r) for r in hn.mine(df, F.expr(anchors), **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


SCHEMA = "vec_id long, label int, embedding array<float>"
usable = lambda df: hn.usable(df, "vec_id", "embedding", F.col("label"))


def test_query(spark, sf_small):
    held = spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, np.floor(256 * np.array(r.embedding, float)).astype(int).tolist()) for r in held]
    got = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in hn.op13_hard_negatives(spark, sf_small).collect())
    assert got and got == brute(rows, lambda i: i % 50 == 0)


def test_blocks_chunks_and_a_hot_label(spark):
    r = random.Random(11)
    rows = [(k, 1 if k % 3 else r.randint(2, 60), [r.randint(-3, 6) for _ in range(70)]) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label long, vec array<long>")
    want = brute(rows, lambda i: i % 3 == 0)
    assert mined(df) == want
    assert mined(df, row_block=16, anchor_block=7) == want
    assert mined(df, row_block=16, anchor_block=1000) == want


def test_ties_and_zero_windows(spark):
    rows = [(k, k % 2, [1, 0]) for k in range(40)] + [(k, k % 2, [0, 2]) for k in range(40, 60)]
    df = spark.createDataFrame(rows, "vec_id long, label long, vec array<long>")
    assert mined(df, row_block=8) == brute(rows, lambda i: i % 3 == 0)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, k % 3, [float(k % 5), 1.0, -0.001]) for k in range(1, 30)]
    odd = [(30, None, [1.0, 1.0, 1.0]), (33, 1, None), (36, 1, [1.0, None, 1.0]), (39, 1, [nan, 1.0, 1.0]), (42, 1, [1.0, -inf, 1.0]), (45, 1, [1.0, 1.0]), (48, 1, []), (None, 1, [1.0, 1.0, 1.0])]
    want = brute([(i, c, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist()) for i, c, v in good], lambda i: i % 3 == 0)
    assert want and mined(usable(spark.createDataFrame(good + odd + good, SCHEMA))) == want
    assert mined(usable(spark.createDataFrame([], SCHEMA))) == []
    assert mined(usable(spark.createDataFrame(odd, SCHEMA))) == []
    assert mined(usable(spark.createDataFrame(good, SCHEMA)), "false") == []


def test_rows_that_share_an_id(spark):
    rows = [(3, 1, [4, 0]), (3, 1, [0, 4]), (4, 1, [4, 4]), (5, 2, [3, 2]), (6, 2, [2, 3])]
    df = spark.createDataFrame(rows, "vec_id long, label long, vec array<long>")
    got = mined(df, "vec_id = 3")
    assert got == sorted(((3, 4, 1, 5, 16, 12), (3, 4, 2, 6, 16, 8), (3, 4, 1, 6, 16, 12), (3, 4, 2, 5, 16, 8)))


def test_extra_columns_and_wide_numbers(spark):
    rows = [(1, 1, [1e8, 1.0]), (2, 1, [1e6, 2.0]), (3, 2, [7e5, 1.0]), (4, 2, [9e5, 1.0])]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "vec_id long, label int, embedding array<double>, number string, block int")
    want = brute([(i, c, np.floor(256 * np.array(v)).astype(int).tolist()) for i, c, v in rows], lambda i: i == 1)
    assert want and mined(usable(df), "vec_id = 1") == want


def test_products_are_exact():
    r = np.random.default_rng(1)
    for top in (3, 2**26, 2**28):
        a, b = r.integers(-top, top, (5, 30)), r.integers(-top, top, (7, 30))
        assert hn.multiply(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]


def test_many_stripes_and_no_shuffled_scores(spark, monkeypatch):
    r = random.Random(12)
    rows = [(k, 1 if k % 4 else r.randint(2, 9), [r.randint(-3, 6) for _ in range(40)]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, label long, vec array<long>")
    plans, kept = [], hn.written
    monkeypatch.setattr(hn, "written", lambda df, tag: (plans.append(df._jdf.queryExecution().toString()), kept(df, tag))[1])
    # Stripes of two blocks of rows and four of anchors.
    monkeypatch.setattr(hn, "STRIPE", 40 * 16 * 2)
    monkeypatch.setattr(hn, "MIN_STRIPES", 3)
    assert mined(df, row_block=16, anchor_block=8) == brute(rows, lambda i: i % 3 == 0)
    # Blocks travel, and a few rows an anchor; partial tiles did before.
    assert plans and not any("tile" in p for p in plans)

import numpy as np
from pyspark.sql import functions as F

from varve.llm import neighbours


def brute(ids, x, k=10, every=100):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, far)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), far[j]) for j in order]
    return out


def test_probing_retrieves_every_code_in_the_radius():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 2**64, (3000, neighbours.BITS // 64), dtype=np.uint64)
    for k in range(200):
        at = rng.choice(neighbours.BITS, rng.integers(0, 60), replace=False)
        flip = np.zeros(neighbours.BITS, np.uint8)
        flip[at] = 1
        codes[k] = codes[5] ^ np.packbits(flip, bitorder="little").view("<u8")
    index = neighbours.Index(codes)
    far = neighbours.apart(codes, codes[5])
    for r in (0, 1, 3, 7, 15, 16, 20, 27, 47, 64, 100, 256):
        assert index.within(codes[5], r).tolist() == np.flatnonzero(far <= r).tolist()
    # Close codes are found among few rows.
    assert len(index.probed(codes[5], 15)) < 300


def test_flips_and_values_give_the_same_rows(monkeypatch):
    rng = np.random.default_rng(6)
    index = neighbours.Index(rng.integers(0, 2**64, (2000, neighbours.BITS // 64), dtype=np.uint64))
    by_flips = [index.probed(index.codes[i], r).tolist() for i in (0, 9) for r in (5, 20, 33)]
    monkeypatch.setattr(neighbours, "n_flips", lambda r: 1 << 30)
    assert by_flips == [index.probed(index.codes[i], r).tolist() for i in (0, 9) for r in (5, 20, 33)]


def test_recall_beyond_the_sample(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    held = rows.collect()
    ids, x = np.array([r.vec_id for r in held]), np.array([r.embedding for r in held], float)
    want = brute(ids, x, every=20)
    got = {}
    for r in neighbours.nearest(rows, F.col("vec_id") % 20 == 0, sample_size=400, query_block=30).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)


def test_recall_of_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    want = brute(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float))
    got = {}
    for r in sorted(neighbours.op6_neighbours(spark, folder).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(got[q]) == 10 for q in want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    far = {(q, v): s for q in want for v, s in want[q]}
    assert all(abs(far.get((q, v), s) - s) < 1e-12 for q in got for v, s in got[q])


def test_edges_of_input(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    got = sorted(tuple(r) for r in neighbours.nearest(df, F.col("vec_id") == 0).collect())
    assert [(q, k, v) for q, k, v, _ in got] == [(0, 1, 1), (0, 2, 9), (0, 3, 2)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_repeated_queries_and_two_vectors_under_one_id(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 8)).round(3)
    rows = [(k, x[k].tolist()) for k in range(60)]
    more = [rows[0], rows[0], rows[0], rows[20], (20, x[3].tolist())]
    df = spark.createDataFrame(rows + more, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, sample_size=50, index_block=16).collect()]
    held = [(i, np.array(v)) for i, v in rows + more]

    def brute_list(q, v):
        far = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in held if i != q)[:10]
        return [(q, k, i, d) for k, (d, i) in enumerate(far, 1)]

    want = sum((brute_list(q, v) for q, v in [(0, x[0]), (20, x[20]), (20, x[3]), (40, x[40])]), [])
    assert [r[:3] for r in sorted(got)] == [r[:3] for r in sorted(want)] and np.allclose([r[3] for r in sorted(got)], [r[3] for r in sorted(want)])

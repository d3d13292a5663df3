import math
import zlib
from collections import Counter

import numpy as np

from varve.llm import lm_score


def toks(text):
    return [w.decode("utf-8", "surrogatepass") for w in (text or "").encode().lower().split()] + [None]


def in_training(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 != 2


def test_base_score_against_brute_force(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    c = Counter(t for r in rows if in_training(r.doc_id) for t in toks(r.text))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lm_score.op3_lm_score(spark, sf_small).collect()}
    assert len(got) == len(rows)
    better = []
    for r in rows:
        x, g = toks(r.text), got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (not in_training(r.doc_id), len(x), sum(c[t] > 0 for t in x), n)
        assert math.isclose(g.base_score, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in x), rel_tol=1e-9)
        if g.held_out:
            better.append(g.score - g.base_score)
    assert np.mean(better) > 0


def test_filter_gives_least_counts_of_levels():
    import pandas as pd

    rng = np.random.default_rng(2)
    key = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    n = rng.geometric(0.3, len(key))
    blob = lm_score.pack_counts(key, n)
    assert all(np.array_equal(a, b) for a, b in zip(lm_score.unpack_counts(blob), (key, n)))
    got = lm_score._bucket_filter(pd.DataFrame({"bucket": [0, 0], "counts": [blob, blob]}))
    f = lm_score.PairFilter(1, [(0, len(got["bits"][0]))], iter([(0, got["bits"][0])]))
    assert (f(key) >= lm_score.level(2 * n)).all()
    assert np.mean(f(key) == lm_score.level(2 * n)) > 0.95
    assert np.mean(f(rng.integers(0, 2**63, 4000, dtype=np.uint64)) > 0) < 0.03


def test_broadcast_and_keyed_lookups_give_the_same_scores(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    docs = docs.union(docs.limit(2)).union(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    train = ~lm_score.held_out("doc_id")
    a, b, c = (sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm_score.lm_score(docs, train, **more).collect()) for more in ({}, {"max_tokens": 200}, {"max_filter_bytes": 2000}))
    assert a == b == c and len(a) == 203


def test_shares_are_fitted_on_all_training_texts(spark):
    # What a text says of its own, the others do not: leaving any out changes the shares.
    docs = spark.createDataFrame([(i, f"common word{i % 500} next{(i * i) % 7} tail{i % 3}") for i in range(1500)], "doc_id long, text string")
    whole, less = (sorted((r.doc_id, round(r.score, 9)) for r in lm_score.lm_score(docs, train).collect()) for train in (lm_score.F.lit(True), lm_score.F.col("doc_id") != 700))
    assert all(a != b for a, b in zip(whole, less, strict=True))


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 997}" for i in range(200_000))
    got = lm_score.lm_score(spark.createDataFrame([(0, text), (1, "w1 w2")], "doc_id long, text string"), lm_score.F.lit(True)).collect()
    assert sorted(r.n_tokens for r in got) == [3, 200_001] and all(r.n_known == r.n_tokens for r in got)


def test_fit_on_cells_is_the_fit_on_tokens():
    rng = np.random.default_rng(3)
    c_before = rng.integers(1, 2000, 20000)
    c_pair = np.minimum(lm_score.edge(lm_score.level(rng.integers(1, 300, 20000))), c_before)
    c_token, room = rng.integers(1, 5000, 20000), 100000.0
    got = lm_score.fit_shares(np.bincount(lm_score.fit_cells(c_pair, c_before, c_token, room)))
    use = c_before > 1
    x, y, of = (np.maximum(c_pair - 1, 0) / np.maximum(c_before - 1, 1))[use], c_token[use] / room, lm_score.size_class(c_before)[use]
    want, n = np.full(65, 0.5), np.bincount(of, minlength=65)
    for _ in range(40):
        post = want[of] * x / (want[of] * x + (1 - want[of]) * y)
        want = np.clip((np.bincount(of, post, 65) + 50 * post.mean()) / (n + 50), 0.001, 0.95)
    assert np.abs(got - want).max() < 2e-3


def test_edges_of_input(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "a A", 1.0), (3, "a A b", 1.0), (3, "a A b", 1.0)], "doc_id long, text string, score double")
    got = lm_score.lm_score(docs, ~lm_score.held_out("doc_id")).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 3, 4, 4]
    assert lm_score.lm_score(docs.limit(0), ~lm_score.held_out("doc_id")).count() == 0
    assert all(r.train_tokens == 0 and r.base_score == 0 for r in lm_score.lm_score(docs, lm_score.held_out("doc_id") & lm_score.F.lit(False)).collect())


def test_rows_of_questions_do_not_grow_with_the_square_of_the_text():
    # 6 GB of documents are about 1.6e9 tokens: a chunk asks a bucket many questions even there.
    chunk = lm_score.KEYED_BYTES // 7
    for n in (10**8, 16 * 10**8, 8 * 10**9):
        assert chunk // lm_score.buckets(n) >= 500
    assert [lm_score.buckets(n) for n in (0, 25 * 10**6)] == [8, 50]


def test_keyed_answers_serve_fit_and_scores(spark, monkeypatch):
    # One pass of questions: the workers read what has met, and not the texts again.
    docs = spark.createDataFrame([(i if i % 9 else None, None if i == 5 else f"Common word{i % 50} next{(i * i) % 7} \t tail{i % 3}" * (i % 4)) for i in range(600)], "doc_id long, text string")
    train = lm_score.F.when(lm_score.F.col("doc_id") % 4 > 0, True)  # null for some
    want, got = (sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in lm_score.lm_score(docs, train, **more).collect()) for more in ({}, {"max_tokens": 0}))
    assert got == want and len(got) == 600
    monkeypatch.setattr(lm_score, "BUCKET_TOKENS", 20)
    monkeypatch.setattr(lm_score, "MANY_BUCKETS", 70)
    assert lm_score.buckets(3000) == 70
    many, some = (sorted((str(r.doc_id), round(r.base_score, 9), round(r.score, 9)) for r in lm_score.lm_score(docs, train, **more).collect()) for more in ({"max_tokens": 0}, {}))
    assert many == some

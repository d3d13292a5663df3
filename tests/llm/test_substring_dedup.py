import hashlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from varve.llm import substring_dedup as sd


def brute(docs, window):
    words = [(i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_query_against_brute_force(spark, sf_small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in sd.op1_substring_dedup(spark, sf_small).collect()) == brute(docs, 13)


def test_edges_of_input(spark):
    run = " ".join(f"w{i}" for i in range(20))
    docs = [(1, None), (2, ""), (5, "a " * 40), (4, "b a " + "a " * 30), (9, run), (9, run), (10, f"x {run}\ty"), (7, run + " a " + run), (12, "é" + run)]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, kept_sha256 string")
    assert sorted(tuple(r) for r in sd.strip_repeats(df).collect()) == brute(docs, 13)
    assert sd.strip_repeats(df.limit(0)).count() == 0
    text = {r.doc_id: r.kept_text for r in sd.strip_repeats(df, with_text=True).collect()}
    assert text[10] == "x y" and text[7] is None


def test_null_id_is_greater_than_any(spark):
    run = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, run), (3, run)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in sd.strip_repeats(df).collect()} == {None: 20, 3: 0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"bb", b"ccccccccccc", "é".encode()]), max_size=30).map(b" ".join), max_size=6))
def test_every_shared_window_shares_an_anchor(texts):
    window, seed = 6, 3
    a = sd.Anchored(texts, window, seed)
    chosen = {}
    for at, anchor in zip(a.at.tolist(), a.anchor.tolist()):
        content = tuple(a.words[at : at + window].tolist())
        assert chosen.setdefault(content, anchor - at) == anchor - at


def test_hot_seeds_give_the_same(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 13)
    for places in (2, 30, 10_000):
        assert sorted(tuple(r) for r in sd.strip_repeats(df, hot_places=places).collect()) == want


def test_seeds_that_collide_are_told_apart_by_their_words():
    a, b = [f"w{i}".encode() for i in range(14)], [f"v{i}".encode() for i in range(14)]
    around = [b" ".join(x) for x in (a, b, a, b[1:] + b"y".split(), a[:13])]
    rows = pa.record_batch({"key": pa.array([7] * 5), "doc": pa.array([1, 2, 3, 4, 5]), "tag": pa.array([0] * 5), "span": pa.array([1, 1, 1, 1, 0]), "around": pa.array(around)})
    got = [tuple(r.values()) for batch in sd._meet(13)(iter([rows])) for r in batch.to_pylist()]
    # Document 3 is 1 as a whole; 4 shares its first window with 2; 5 its only one with 1; 2 shares none.
    assert got == [(3, 0, 1), (4, 0, 0), (5, 0, 0)]


def test_windows_whose_first_hash_collides_are_told_apart(monkeypatch):
    texts = [" ".join(f"{x}{i}" for i in range(13)).encode() for x in "abca"]
    a = sd.Anchored(texts, 13, 5, True)
    every, real = (lambda h: np.ones(len(h), bool)), sd.grams
    monkeypatch.setattr(sd, "grams", lambda h, n: real(h, n) * np.uint64(h is not a.words))
    w = sd._Windows(a, every, np.arange(4), 4, 13)
    assert not w.h[0].any() and w.open.tolist() == [True, True, True, False]


def test_a_very_long_text(spark):
    run = " ".join(f"r{i}" for i in range(30))
    long = " ".join(f"x{i}" for i in range(150_000))
    docs = [(1, f"{long} {run}"), (2, f"{run} {long} {run}"), (3, run)]
    got = sorted(tuple(r) for r in sd.strip_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == brute(docs, 13)


def test_texts_under_one_id_keep_their_own_spans(spark):
    run, other = " ".join(f"w{i}" for i in range(20)), " ".join(f"v{i}" for i in range(20))
    docs = [(5, f"a {run}"), (5, f"{other} b c d"), (1, run), (2, other), (5, f"a {run}")]
    got = sorted(tuple(r) for r in sd.strip_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == brute(docs, 13)

import numpy as np
import xxhash

from varve.llm import simhash


def brute_print(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, radius=3):
    up = list(range(len(ids)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return {d: least[find(i)] for i, d in enumerate(ids)}


def test_fingerprint_matches_brute_force():
    for t in [None, "", " \n", "One", "one Two", "a b c", "Ünï ß A b\x0bc d e f g", "x " * 500 + "y"]:
        assert simhash.fingerprint(t) == brute_print(t)


def test_forest_spans_exactly_the_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(k)) for k in (0, 7, 21)] + [base]))
    prints = prints[np.lexsort((prints, np.bitwise_count(prints)))]
    x, top = simhash.forest(prints, prints, 3, True)
    got = np.arange(len(prints))
    got[x] = top
    want = brute_components(range(len(prints)), [int(p) for p in prints])
    assert {i: int(g) for i, g in enumerate(got)} == want


def test_query_against_brute_force(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    want = brute_components([r.doc_id for r in rows], [brute_print(r.text) for r in rows])
    got = simhash.op10_simhash(spark, sf_small).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == {r.doc_id: brute_print(r.text) for r in rows}


def test_edges_of_input(spark):
    docs = spark.createDataFrame([(4, None, "x"), (2, "", "y"), (9, "a b c d", "z"), (9, "a b c d", "z"), (None, "q r s", "z")], "doc_id long, text string, component_id string")
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs, tile=2).select("doc_id", "component_id").collect() if r[0] is not None)
    assert got == [(2, 2), (4, 2), (9, 9), (9, 9)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_keeps_each_text_without_an_id(spark):
    rows = [(None, "q r s t u"), (None, "one two three four five six"), (None, "one two three four five six"), (None, None), (7, "alpha beta gamma delta"), (None, "alpha beta gamma delta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in simhash.keep_one(docs).collect()]
    want = [(None, "q r s t u"), (None, "one two three four five six"), (None, None), (7, "alpha beta gamma delta")]
    assert sorted(got, key=str) == sorted(want, key=str)


def _prints(spark, prints):
    return spark.createDataFrame([(p, p) for p in prints.view(np.int64).tolist()], "node long, print long").withColumn("ones", simhash.F.bit_count("print"))


def test_prints_far_apart_are_not_compared(spark, monkeypatch):
    # Random prints: the pairs that share a band are few, where all pairs were compared before.
    monkeypatch.setattr(simhash, "tiled", lambda *_: 1 / 0)
    rng = np.random.default_rng(8)
    prints = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    near = prints[:200] ^ (np.uint64(1) << np.uint64(3)) ^ (np.uint64(1) << np.uint64(40)) ^ (np.uint64(1) << np.uint64(63))
    far = prints[200:400] ^ np.uint64(0x0001000100010001)
    got = simhash.links(_prints(spark, np.concatenate([prints, near, far]))).collect()
    assert {frozenset((r.a, r.b)) for r in got} == {frozenset(x) for x in zip(prints[:200].view(np.int64).tolist(), near.view(np.int64).tolist())}


def test_bands_shared_by_many_and_by_few(spark):
    # Prints that share a band, in runs of 1 to 300, some beyond a tile: no link is lost.
    rng = np.random.default_rng(4)
    hot = rng.integers(0, 2**48, 300, dtype=np.uint64) << np.uint64(16) | np.uint64(77)
    hot = np.concatenate([hot, hot[:90] ^ (np.uint64(5) << np.uint64(30)), hot[:60] ^ np.uint64(2)])
    base = rng.integers(0, 2**64, 12, dtype=np.uint64)
    chains = np.concatenate([base ^ np.uint64((1 << k) - 1) for k in range(0, 40, 3)])
    prints = np.unique(np.concatenate([hot, chains]))
    ids = prints.view(np.int64).tolist()
    for radius in (0, 1, 3, 9):
        want = brute_components(ids, [int(p) for p in prints], radius)
        for tile in (7, 100, 8192):
            of = {r.node: r.component for r in simhash.components(simhash.links(_prints(spark, prints), radius, tile)).collect()}
            assert {i: of.get(i, i) for i in ids} == want

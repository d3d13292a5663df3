import math
import zlib

import numpy as np

from varve.llm import toxicity


def brute_kernel(a, b):
    def subs(w):
        out = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + toxicity.DECAY ** (k - i + 1)
        return out

    x, y = subs(a), subs(b)
    dot = lambda p, q: sum(v * q.get(s, 0) for s, v in p.items())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y)) if x and y else 0.0


def test_kernel_against_brute_force():
    marks, words = ["idiot", "stupid", "clown"], ["idiot", "idxiot", "stupidest", "crown", "ththththclown", "ab", "clowning"]
    got = toxicity.Kernel(marks)(words)
    want = np.array([[brute_kernel(w, m) for m in marks] for w in words])
    assert np.allclose(got, want, atol=1e-4)


def test_held_out_rows(spark):
    rng = np.random.default_rng(1)
    plain = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliett"]
    rows = [(i, " ".join(rng.choice(plain, 30)) + (" idiot" if i % 4 == 0 else "") + ".", i % 4 == 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, ""), (9003, "you id-iot"), (9004, "i d i o t ok")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 604 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].predicted == int(y) for i, _, y in rows)
    assert got[9001].predicted == got[9002].predicted == 0
    assert got[9003].predicted == got[9004].predicted == 1


def test_a_sentence_s_feature_is_a_sum_of_word_kernels():
    marks, words = ["idiot", "moron"], ["you", "idxiot", "and", "maron", "idiot", "so", "it", "goes"]
    sample = toxicity.Sample([words], toxicity.Kernel(marks))
    got = sample.features([tuple(sample.texts[0].tolist())])[0]
    want = [sum(brute_kernel(w, m) ** p for w in words if len(w) >= 3) for p in toxicity.POWERS for m in marks]
    assert np.allclose(got, want, atol=2e-3)
    # The kernel of sentences is one: its matrix over any of them has no negative eigenvalue.
    some = [words[:3], words[2:6], ["idiot", "idiot"], ["crown", "clown"], ["maron", "moron", "idiots"]]
    matrix = [[sum(brute_kernel(a, b) ** p for a in x for b in y for p in toxicity.POWERS) for y in some] for x in some]
    assert np.linalg.eigvalsh(np.array(matrix)).min() > -1e-9


def test_a_text_has_the_margin_of_its_worst_run():
    rng = np.random.default_rng(5)
    own = rng.normal(size=200)
    assert np.isclose(toxicity.steepest(own, 6)[0], max(own[i : i + 6].sum() for i in range(195)))
    assert np.isclose(toxicity.steepest(own[:4], 6)[0], own[:4].sum())


def test_words_with_letters_put_in():
    marks, words = ["idiot", "moron", "loser"], ["idxizot", "ixdqiot", "mxorqon", "lozsewr", "ixdqizot", "mxoqrzon"]
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(400)]
    texts = [" ".join(rng.choice(plain, 20)) + (f" {marks[i // 4 % 3]}" if i % 4 == 0 else "") for i in range(900)]
    model = toxicity.fit(texts, (np.arange(900) % 4 == 0).astype(np.int64))
    assert model.scores([None])[0] < 0.5 and np.mean(model.scores([" ".join(rng.choice(plain, 20)) for _ in range(200)]) < 0.5) > 0.9
    assert (model.scores(["fine " + w for w in words]) > model.scores(["fine"])).all()
    assert (model.scores(["fine " + w for w in ("idxiot", "moqron", "loszer")]) >= 0.5).all()
    # At the end of a very long clean text as well, and whatever else a worker remembers.
    calm = [w for w, p in zip(plain, model.scores([" ".join([w] * toxicity.RUN) for w in plain])) if p < 0.1]
    long = " ".join(rng.choice(calm, 30_000))
    assert model.scores([long])[0] < 0.5 <= model.scores([long + " idiot"])[0]


def test_a_word_of_few_toxic_texts_is_a_landmark():
    words = [{"idiot", f"text{i}"} for i in range(1000)] + [{"moron", f"more{i}"} for i in range(3)] + [{"plain", f"rest{i}"} for i in range(1000)]
    toxic = np.r_[np.ones(1003, np.int64), np.zeros(1000, np.int64)]
    assert toxicity.choose_landmarks(words, toxic) == ["idiot", "moron"]
    assert toxicity.choose_landmarks(words[1000:], toxic[1000:]) == ["moron"]


def test_edges_of_input(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(docs, none)
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0]
    assert toxicity.score(docs.limit(0), model).count() == 0
    rows = [(i, f"alpha bravo {i}" + (" idiot" if i % 2 else ""), 1, 0.5) for i in range(80)] + [(None, "you idiot", 2, 0.1), (7, "fine", 3, 0.2), (7, "fine", 3, 0.2), (None, None, 4, 0.3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score double")
    labels = spark.createDataFrame([(i, i % 2, "z") for i in range(80)] + [(7, 0, "y"), (None, 1, "y"), (9, None, "y")], "doc_id long, toxic int, text string")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 84 and sorted(r.predicted for r in got if r.doc_id is None) == [0, 1]
    assert [r.predicted for r in got if r.doc_id == 7].count(0) == 2
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == 43
    # A bound on the bytes of the sample leaves a smaller sample, not a failure.
    assert toxicity.learn(docs, labels, max_bytes=0).constant == 0.0


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"  # enough held-out labels for shares to mean something
    got = {r.doc_id: r for r in toxicity.op9_toxicity(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out and r.toxic is not None]
    caught, clean = [p for p, y in held if y], [p for p, y in held if not y]
    # Some labels are noise, so not all can be met.
    assert len(caught) > 90 and np.mean(clean) < 0.02 and np.mean(caught) > 0.8, (len(caught), np.mean(caught), np.mean(clean))
    # By brute force: every score is that of the text's worst run of words.
    model = toxicity.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    for i in sorted(docs)[:40]:
        words, joined = toxicity.words_of(docs[i])
        own = lambda w: sum(model.weights[n + k * len(model.landmarks)] * brute_kernel(toxicity.clean(w), m) ** p for n, m in enumerate(model.landmarks) for k, p in enumerate(toxicity.POWERS)) if 3 <= len(toxicity.clean(w)) <= toxicity.WINDOW else None
        if len(words) > 60 or any(len(toxicity.clean(w)) > toxicity.WINDOW or not w.isascii() for w in words):
            continue
        value = [own(w) or 0.0 for w in words]
        best = max(sum(value[k : k + toxicity.RUN]) for k in range(max(1, len(value) - toxicity.RUN + 1)))
        want = model.curve[0] * (model.offset + max([best, *(own(w) or 0.0 for w in joined)])) + model.curve[1]
        assert abs(got[i].score - 1 / (1 + np.exp(-want))) < 1e-3

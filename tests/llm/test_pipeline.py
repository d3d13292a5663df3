import re

import pytest
from test_exact_dedup import norm
from test_simhash import brute_components, brute_print

import corpus_pipeline as cp
from varve.llm import common, pipeline, toxicity
from varve.llm.common import table, written


def test_stages_against_brute_force(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "exact dedup", "near-dedup", "mixing", "packing"]
    held = {r.doc_id: r for r in docs.collect()}
    model = toxicity.learn(docs, table(spark, sf_small, "labels"))
    ids = sorted(held)
    clean = {i for i, s in zip(ids, model.scores([held[i].text for i in ids])) if s < 0.5}
    first = {}
    for i in sorted(clean):
        first.setdefault(norm(held[i].text), i)
    single = set(first.values())
    part = brute_components(sorted(single), [brute_print(held[i].text) for i in sorted(single)])
    want = [clean, single, set(part.values())]
    for (_, stage), keep in zip(cp.STAGES[:3], want):
        docs = written(stage(spark, docs, sf_small), "t")
        rows = docs.collect()
        assert sorted(r.doc_id for r in rows) == sorted(keep) and all(r == held[r.doc_id] for r in rows)
    mixed = written(pipeline.mix_sources(spark, docs, sf_small), "t")
    assert mixed.columns == docs.columns
    texts = {}
    for r in mixed.collect():
        # A run of words of the document, or all of it.
        assert f" {' '.join(re.findall(r'[^ \t-\r]+', r.text))} " in f" {' '.join(re.findall(r'[^ \t-\r]+', held[r.doc_id].text))} "
        texts.setdefault(r.doc_id, []).append(r.text)
    packed = pipeline.pack_sequences(spark, mixed, sf_small).collect()
    assert sum(r.start == 0 for r in packed) == sum(map(len, texts.values()))
    once = {i: t[0] for i, t in texts.items() if len(t) == 1}
    room = {}
    for r in packed:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in room.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    single_rows = [r for r in packed if r.doc_id in once]
    sizes = {}
    for r in single_rows:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert all(sizes[r.doc_id] == r.doc_tokens for r in single_rows)


def test_run_is_the_stages_in_turn(spark, sf_small, monkeypatch):
    pieces = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    docs = table(spark, sf_small, "documents")
    for _, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_small), "t")
    want = pieces(pipeline.pack_sequences(spark, docs, sf_small))
    got = cp.run(spark, sf_small)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pieces(got) == want


def test_a_run_goes_on_behind_its_last_stage(spark, sf_small, monkeypatch):
    ran = []

    def watched(name, stage, fails):
        def run(spark, docs, sf_dir):
            ran.append(name)
            if fails:
                raise RuntimeError("lost")
            return stage(spark, docs, sf_dir)

        return name, run

    monkeypatch.setattr(pipeline, "STAGES", [watched(n, f, n == "mixing") for n, f in cp.STAGES])
    with pytest.raises(RuntimeError):
        pipeline.run(spark, sf_small, "again")
    monkeypatch.setattr(pipeline, "STAGES", [watched(n, f, False) for n, f in cp.STAGES])
    ran.clear()
    rows = pipeline.run(spark, sf_small, "again").count()
    assert ran == ["mixing", "packing"] and rows > 0
    # What it left outlives the session's own files, until it is forgotten.
    assert not any(path.startswith(pipeline.home_of(spark, sf_small, "again")) for _, path in common._written)
    pipeline.forget(spark, sf_small, "again")
    ran.clear()
    pipeline.run(spark, sf_small, "again")
    assert len(ran) == 5
    pipeline.forget(spark, sf_small, "again")


def test_one_name_and_other_input(spark, sf_small, tmp_path, monkeypatch):
    monkeypatch.setattr(pipeline, "STAGES", [("first", lambda spark, docs, sf_dir: docs), ("last", lambda spark, docs, sf_dir: docs)])
    for name in ("documents", "labels"):
        table(spark, sf_small, name).limit(7).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, sf_small, "x").count() == table(spark, sf_small, "documents").count()
    assert pipeline.run(spark, str(tmp_path), "x").count() == 7
    table(spark, sf_small, "documents").limit(5).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path), "x").count() == 5


def test_edges_of_input(spark, sf_small):
    docs = table(spark, sf_small, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a few words alone", "en", None, 17), (None, "quite another text of ours", "en", "s", 26), (900_001, "", "en", "s", 0), (900_002, "x " * 100_000, "en", "s", 5), (900_002, "x " * 100_000, "en", "s", 5)], docs.schema)
    docs = docs.limit(30).unionByName(odd).selectExpr("*", "doc_id AS fingerprint", "1 AS kept", "'z' AS score", "7L AS digest")
    for name, stage in cp.STAGES:
        before, docs = docs, written(stage(spark, docs, sf_small), "t")
        if name != "packing":
            assert docs.columns == before.columns
        if name in ("exact dedup", "near-dedup"):
            texts = [r.text for r in docs.where("doc_id is null").collect()]
            assert {"a few words alone", "quite another text of ours"} <= set(texts)
            assert docs.where("doc_id = 900002").count() == 1
    assert docs.count() > 0


def test_empty_table(spark, sf_small):
    docs = table(spark, sf_small, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_small)
    assert docs.count() == 0

import hashlib
import re
import uuid

from varve.llm import exact_dedup


def norm(t):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()


def index(spark):
    return exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", 4)


def test_query_against_brute_force(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    groups = {}
    for r in rows:
        groups.setdefault(norm(r.text), []).append(r.doc_id)
    want = sorted((d, min(g), len(g), d == min(g), k) for k, g in groups.items() for d in g)
    assert sorted(tuple(r) for r in exact_dedup.op4_exact_dedup(spark, sf_small).collect()) == want


def test_edges_of_input(spark):
    docs = spark.createDataFrame([(3, None, 1), (2, "", 1), (5, "a\t b", 1), (4, "a b", 1), (4, "a b", 1), (None, "a\nb", 1)], "doc_id long, text string, kept int")
    got = exact_dedup.deduplicate(docs, index(spark)).collect()
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in got) == sorted(
        [("3", 2, 2, False), ("2", 2, 2, True), ("5", 4, 4, False), ("4", 4, 4, True), ("4", 4, 4, False), ("None", 4, 4, False)]
    )
    kept = exact_dedup.keep_first(docs, index(spark))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4] and kept.columns == docs.columns
    assert exact_dedup.deduplicate(docs.limit(0), index(spark)).count() == 0


def test_index_keeps_what_earlier_batches_held(spark):
    at = index(spark)
    one = spark.createDataFrame([(7, "x y"), (8, "z")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "x  y"), (2, "new"), (3, "new")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in exact_dedup.deduplicate(one, at).collect()} == {7: True, 8: True}
    assert {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.deduplicate(two, at).collect()} == {1: (7, False), 2: (2, True), 3: (2, False)}
    assert at.read().count() == 3
    plan = two.select(exact_dedup.digest("text").alias("digest")).join(at.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    at.drop()


def test_a_batch_that_is_run_again_gets_the_same_result(spark):
    at = index(spark)
    one = spark.createDataFrame([(7, "x y"), (8, "z")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "x  y"), (2, "new"), (3, "new")], "doc_id long, text string")
    run = lambda df, name: sorted(map(tuple, exact_dedup.deduplicate(df, at, name).collect()))
    first, second = run(one, "one"), run(two, "two")
    assert run(two, "two") == second and run(one, "one") == first and at.read().count() == 3
    assert sorted(r.doc_id for r in exact_dedup.keep_first(two, at, "two").collect()) == [2]
    at.drop()


def test_query_joins_its_batch_to_the_index_and_drops_it(spark, sf_small, monkeypatch):
    seen, unseen = [], exact_dedup.unseen
    monkeypatch.setattr(exact_dedup, "unseen", lambda batch, known: seen.append(unseen(batch, known)) or seen[-1])
    before = {t.name for t in spark.catalog.listTables()}
    plans = []
    drop = exact_dedup.DigestIndex.drop
    monkeypatch.setattr(exact_dedup.DigestIndex, "drop", lambda self: (plans.append(seen[-1]._jdf.queryExecution().executedPlan().toString()), drop(self)))
    n = exact_dedup.op4_exact_dedup(spark, sf_small).count()
    assert n == spark.read.parquet(f"{sf_small}/documents.parquet").count()
    assert "SortMergeJoin" in plans[0] and "LeftAnti" in plans[0] and "Bucketed: true" in plans[0]
    assert {t.name for t in spark.catalog.listTables()} == before


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w  " * 400_000), (2, "w " * 400_000)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in exact_dedup.deduplicate(docs, index(spark)).collect()} == {1: True, 2: False}

import re

from varve.llm import mixing


def highest_quotients(votes, seats, caps):
    out = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if out[i] < caps[i] and votes[i] > 0]
        if not open_:
            break
        i = max(open_, key=lambda i: (votes[i] / (2 * out[i] + 1), -i))
        out[i] += 1
    return out


def test_sainte_lague_is_highest_quotients():
    import random

    r = random.Random(2)
    for n in (1, 2, 5, 9):
        for seats in (0, 1, 7, 50, 333):
            votes = [r.choice([0, 1, 10, 1000]) * r.random() for _ in range(n)]
            caps = [r.choice([seats, 3, 20]) for _ in range(n)]
            if sum(votes):
                assert mixing.sainte_lague(votes, seats, caps) == highest_quotients(votes, seats, caps)


def test_targets_stop_at_three_times_the_size():
    got = mixing.targets([10, 1000, 1000], [5, 2, 1], 2010)
    assert got[0] == 30 and abs(got[1] - 1320) < 1e-9 and abs(got[2] - 660) < 1e-9


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_query(spark, sf_small):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = mixing.op2_mixing(spark, sf_small).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, mixing.op2_mixing(spark, sf_small).collect()))
    sizes, taken, target = {}, {}, {}
    for g in got:
        r = rows[g.doc_id]
        assert g.size == size(r.text) and 0 <= g.taken <= 3 * g.size
        sizes[r.source] = sizes.get(r.source, 0) + g.size
        taken[r.source] = taken.get(r.source, 0) + g.taken
        target[r.source] = g.target
    assert all(g.source_size == sizes[rows[g.doc_id].source] for g in got)
    order = sorted(sizes)
    want = mixing.targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], sum(sizes.values()))
    for s, t in zip(order, want):
        assert abs(target[s] - t) < 1e-6 and abs(taken[s] - t) <= max(2, 0.01 * t)


def test_blocks_against_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = mixing.mix(docs, shard_docs=4).collect()
    shards = {}
    for g in got:
        shards.setdefault((g.source, g.shard), []).append(g)
    assert len(shards) > len({s for s, _ in shards})
    totals = [(s, k, sum(g.size for g in rows)) for (s, k), rows in shards.items()]
    for source, shard, _, _, quota, held, block, n, step in mixing.plan(totals):
        rows = shards[source, shard]
        assert sum(g.taken for g in rows) == quota and len({step * j % n for j in range(n)}) == n
        whole, rest = divmod(quota, held) if held else (0, 0)
        assert {g.whole for g in rows} == {whole}
        # Laid end to end in the seeded order, the runs are whole blocks, but for one.
        seed = {r.doc_id: r.draw for r in docs.select("doc_id", mixing.F.xxhash64(mixing.F.lit(17), "doc_id", "text").alias("draw")).collect()}
        at, words = 0, []
        for g in sorted(rows, key=lambda g: (seed[g.doc_id], g.doc_id)):
            words += [at + w for a, b in g.runs for w in range(a, b)]
            at += g.size
        assert len(set(words)) == len(words) == rest
        per = [sum(w // block == j for w in words) for j in range(n)]
        assert sum(v == block for v in per) == min(rest // block, n) and sum(0 < v < block for v in per) <= 1


def test_more_sources_than_fifty_thousand(spark):
    docs = spark.range(52_000).selectExpr("id AS doc_id", "'a b c' AS text", "cast(id AS string) AS source")
    got = mixing.mix(docs).agg({"taken": "sum", "*": "count"}).first()
    assert got[0] == 156_000 and got[1] == 52_000


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "x y", "b")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert got[1].size == 300_000 and abs(got[1].taken - got[1].target) <= 1 and got[2].taken == 6
    assert sum(size(r.text) for r in mixing.mixed(docs).collect()) == got[1].taken + 6


def test_mixed_takes_what_the_plan_says(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    plan = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    got = {}
    for r in mixing.mixed(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + size(r.text)
        assert r.n_chars == len(r.text)
    assert got == {d: t for d, t in plan.items() if t}


def test_edges_of_input(spark):
    docs = spark.createDataFrame([(1, None, "a", 1), (2, "x y z", None, 1), (2, "x y z", None, 1), (None, "q r", "b", 1), (4, "", "c", 1)], "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    assert len(got) == 5 and sum(r.taken for r in got) == 8
    out = mixing.mixed(docs)
    assert sum(size(r.text) for r in out.collect()) == 8 and out.columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0

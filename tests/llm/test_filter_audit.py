import re
from itertools import permutations

from pyspark.sql import functions as F

from varve.llm import filter_audit


def brute(docs, labels):
    """Every order applied to every part's rows, row by row."""
    marks = {}
    for doc_id, good, toxic in labels:
        old = marks.get(doc_id, (False, False))
        if doc_id is not None:
            marks[doc_id] = (old[0] or good == 1, old[1] or toxic == 1)
    first, rows = {}, {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": text in first and (doc_id is None or doc_id > first[text]),
        }
        rows.setdefault(lang or "", []).append((fails, *marks.get(doc_id, (False, False))))
    out = {}
    for part, held in rows.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = held
            for step, f in enumerate(order, 1):
                gone, stay = [r for r in left if r[0][f]], [r for r in left if not r[0][f]]
                alone = sum(r[0][f] and sum(r[0].values()) == 1 for r in held)
                out[part, "".join(order), step] = [len(stay), len(gone), sum(r[0][f] for r in held) - len(gone), alone, sum(r[1] for r in gone), sum(r[2] for r in gone)]
                total[f] += len(gone)
                left = stay
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels, tmp_path, extra=""):
    home = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string" + extra).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    got = filter_audit.op11_filter_audit(spark, home).collect()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


def test_every_order_equals_brute_force(spark, tmp_path):
    distinct = " ".join(f"w{k}" for k in range(150))
    docs = [
        (1, distinct, "en"), (2, distinct, "en"), (2, distinct, "en"), (3, distinct + " #", "en"), (4, "same " * 200, "en"), (5, None, None), (6, "", ""), (7, "ABC", "de"),
        (8, distinct.upper(), "de"), (9, "x|y " * 3000, "de"), (None, distinct, "en"), (None, "alone", "fr"), (10, " \t\n\x0b\x0c\r", None), (11, "a\x85b c", "fr"), (12, "same " * 200, "en"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (3, None, 1), (3, 1, None), (4, 0, 0), (9, 1, 1), (99, 1, 1), (None, 1, 1)]
    assert audited(spark, docs, labels, tmp_path) == brute(docs, labels)


def test_no_rows_and_extra_columns(spark, tmp_path):
    assert audited(spark, [], [(1, 1, 1)], tmp_path / "a") == {}
    docs = [(1, "a", "en", "x", 1), (2, "a", "en", "y", 2)]
    got = audited(spark, docs, [], tmp_path / "b", ", words string, quality int")
    assert got == brute([d[:3] for d in docs], [])


def test_states_are_visited_once_and_released(spark, monkeypatch):
    rows = spark.range(64).select(F.lit("p").alias("part"), *[F.col("id").bitwiseAND(1 << k).cast("boolean").alias(n) for k, n in enumerate("abcd")], F.lit(True).alias("t"))
    walked = filter_audit.walk(rows, list("abcd"), ["t"]).collect()
    assert sorted(r.state for r in walked) == list(range(15))
    by = {r.state: r for r in walked}
    assert all(r.here == 64 >> bin(s).count("1") and all(e["removed"] == r.here // 2 == e["lost_t"] for e in r.edges) and len(r.edges) == 4 - bin(s).count("1") for s, r in by.items())
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_query(spark, sf_small):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()]
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.op11_filter_audit(spark, sf_small).collect()}
    assert got == brute(docs, labels)

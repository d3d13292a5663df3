"""How filters overlap: every order of several filters, run over a trie of shared states.

The orders of n filters are the paths of a trie. What survives a path depends only on
which filters it has passed, so the states of the trie are the 2^n sets of filters: a set
reached by another path is not visited again. The trie is walked depth first. At each
state the surviving rows are a persisted DataFrame, filtered from the parent's; one
aggregate of them counts what each next filter removes there, for all edges that leave
the state, and is written to the shared folder; the state is released once its subtree is
done, so at most n + 1 states are held. A lost block is made again from the rows judged
in the beginning, at most n filters away.

Conditions are evaluated once for each row, where texts are read; the trie runs over
narrow rows of part, failures and tallies. The counts of a state are one row a part, and
stay in Spark.

Defined results: a null text is empty; a null part is a part of its own (the query names
it by the empty string); repeated rows count each; a row repeats another if its text
stands under a smaller id, where a null id is larger than all others and no id is smaller
than itself; texts are told apart by their SHA-256; a row without labels or without an id
has no tally, and of several label rows for one id any 1 counts; an empty table has no parts and gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm.common import SPACE, shared_dir, table, written, written_at


def repeats(rows: DataFrame, key: str, id_col: str, out: str) -> DataFrame:
    """Adds out: the row's key stands under a smaller id. Keys are reduced before they
    meet, and the join's hot keys are split by the skew-join rule."""
    first = rows.groupBy(F.col(key).alias("__key")).agg(F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    later = F.col("__first").isNotNull() & (F.col(id_col).isNull() | (F.col(id_col) > F.col("__first")))
    x = rows.join(first, rows[key] == first["__key"], "left")
    return x.withColumn(out, F.coalesce(later, F.lit(False))).drop("__key", "__first", "__n")


def judged(docs: DataFrame, conditions: dict[str, Column], repeat: str | None = None, part: Column | None = None, labels: DataFrame | None = None, tallies: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow rows: part, a boolean for each filter (true: the row fails it), and one for
    each tally. conditions: by name, on the columns of docs; repeat: the name of the filter
    of repeated texts; tallies: conditions on the columns of labels, which has id_col."""
    tallies = tallies or {}
    names = [*conditions, *([repeat] if repeat else [])]
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    rows = docs.select(
        (part if part is not None else F.lit("")).alias("part"), F.col(id_col).alias("__id"), *([digest.alias("__digest")] if repeat else []),
        *[F.coalesce(c, F.lit(False)).alias(n) for n, c in conditions.items()],
    )
    if repeat:
        rows = repeats(written(rows, "judged"), "__digest", "__id", repeat)
    if labels is not None and tallies:
        marks = labels.groupBy(F.col(id_col).alias("__label_id")).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in tallies.items()])
        rows = rows.join(marks, rows["__id"] == marks["__label_id"], "left")
    held = [F.coalesce(F.col(n), F.lit(False)).alias(n) if labels is not None else F.lit(False).alias(n) for n in tallies]
    return rows.select("part", *names, *held)


def walk(rows: DataFrame, names: list[str], tallies: list[str]) -> DataFrame:
    """Counts of the trie's edges: part, state (bit k: names[k] was applied), here (rows of
    the state), edges: filter, removed and lost_<tally> by the filter at that state."""
    spark = rows.sparkSession
    home = f"{shared_dir(spark)}/varve/trie-{uuid.uuid4().hex}"
    seen: set[int] = set()

    def visit(state: int, survivors: DataFrame) -> None:
        seen.add(state)
        held = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        rest = [k for k in range(len(names)) if not state >> k & 1]
        edges = [
            F.struct(F.lit(names[k]).alias("filter"), F.count_if(names[k]).alias("removed"), *[F.count_if(F.col(names[k]) & F.col(t)).alias(f"lost_{t}") for t in tallies])
            for k in rest
        ]
        counts = held.groupBy("part").agg(F.count(F.lit(1)).alias("here"), F.array(*edges).alias("edges"))
        written_at(counts.coalesce(1), f"{home}/state={state}")
        for k in rest:
            # The state of all filters has no edge: what is left there is its parent's count.
            if len(rest) > 1 and state | 1 << k not in seen:
                visit(state | 1 << k, held.where(~F.col(names[k])))
        held.unpersist()

    visit(0, written(rows, "trie"))
    fields = "".join(f", lost_{t}: bigint" for t in tallies)
    return spark.read.schema(f"part string, here bigint, edges array<struct<filter: string, removed: bigint{fields}>>, state int").parquet(home)


def orders(walked: DataFrame, names: list[str], tallies: list[str]) -> DataFrame:
    """One row for each part, order of the filters and step: part, filter_order (names run
    together), step, filter, kept, removed, redundant, unique_fails, lost_<tally>, shapley.
    Parts are rows: each holds the n * 2^(n-1) edges of the trie."""
    every = list(permutations(names))
    bit = {n: 1 << k for k, n in enumerate(names)}
    whole = (1 << len(names)) - 1
    edges = walked.select("part", "state", "here", F.explode("edges").alias("e"))
    facts = ["removed", *[f"lost_{t}" for t in tallies]]
    key = F.concat_ws(":", F.col("state").cast("string"), "e.filter")
    value = F.struct("here", *[F.col(f"e.{c}").alias(c) for c in facts])
    # A part of which nothing survives has no row at later states: nothing is removed there.
    parts = edges.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("at"))
    none = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ["here", *facts]])
    at = lambda state, f: F.coalesce(F.try_element_at("at", F.concat_ws(":", state.cast("string"), f)), none)
    x = parts.withColumn("order", F.explode(F.lit(["\t".join(o) for o in every]))).withColumn("order", F.split("order", "\t"))
    x = x.select("part", "at", "order", F.posexplode("order").alias("pos", "filter"))
    bits = F.create_map(*[F.lit(v) for n, b in bit.items() for v in (n, b)])
    x = x.withColumn("state", F.aggregate(F.slice("order", 1, F.col("pos")), F.lit(0), lambda a, n: a + bits[n]))
    x = x.withColumns({"edge": at(F.col("state"), F.col("filter")), "first": at(F.lit(0), F.col("filter")), "last": at(F.lit(whole) - bits[F.col("filter")], F.col("filter"))})
    # Every order passes one edge of the filter; as many orders pass it as have the same set before it.
    times = {}
    for o in every:
        for k, n in enumerate(o):
            edge = (sum(bit[m] for m in o[:k]), n)
            times[edge] = times.get(edge, 0) + 1
    total = lambda n: sum((at(F.lit(s), F.lit(n))["removed"] * c for (s, m), c in times.items() if m == n), F.lit(0).cast("bigint"))
    x = x.withColumn("shapley", F.coalesce(*[F.when(F.col("filter") == n, total(n)) for n in names]))
    return x.select(
        "part", F.concat_ws("", "order").alias("filter_order"), (F.col("pos") + 1).alias("step"), "filter",
        (F.col("edge.here") - F.col("edge.removed")).alias("kept"), F.col("edge.removed").alias("removed"),
        (F.col("first.removed") - F.col("edge.removed")).alias("redundant"), F.col("last.removed").alias("unique_fails"),
        *[F.col(f"edge.lost_{t}").alias(f"lost_{t}") for t in tallies], "shapley",
    )


def audit(rows: DataFrame, names: list[str], tallies: list[str]) -> DataFrame:
    """orders() of a walk over judged rows."""
    return orders(walk(rows, names, tallies), names, tallies)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    docs = docs.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    docs = docs.withColumns({"n_words": F.size("words"), "n_distinct": F.size(F.array_distinct("words"))})
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    conditions = {
        "A": F.col("n_words") < 100, "B": 100 * F.col("n_distinct").cast("long") < 80 * F.col("n_words").cast("long"),
        "C": 100 * capitals.cast("long") > 10 * F.length("text").cast("long"), "D": F.col("text").rlike(r"[#$%&*|]"),
    }
    rows = judged(docs, conditions, "E", F.col("lang"), table(spark, sf_dir, "labels"), {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    return audit(rows, list("ABCDE"), ["good", "toxic"]).withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"}).drop("filter")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
f AS (
  SELECT part, CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS failed,
    coalesce(quality = 1, false)::INT AS good, coalesce(toxic = 1, false)::INT AS bad
  FROM w LEFT JOIN labels USING (doc_id)
),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
l AS (SELECT unnest([0, 1, 2, 3, 4]) AS k),
o AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM l a, l b, l c, l d, l e
  WHERE a.k <> b.k AND a.k <> c.k AND a.k <> d.k AND a.k <> e.k AND b.k <> c.k AND b.k <> d.k AND b.k <> e.k AND c.k <> d.k AND c.k <> e.k AND d.k <> e.k
),
s AS (
  SELECT array_to_string(list_transform(ks, lambda k: chr(65 + k)), '') AS filter_order, step, ks[step] AS k,
    coalesce(list_sum(list_transform(ks[:step - 1], lambda k: 1 << k)), 0)::INT AS passed FROM (SELECT ks, unnest([1, 2, 3, 4, 5]) AS step FROM o)
),
r AS (
  SELECT part, filter_order, step, k,
    coalesce(sum(n) FILTER (failed & (passed | (1 << k)) = 0), 0) AS kept, coalesce(sum(n) FILTER (failed & passed = 0 AND failed & (1 << k) <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (failed & passed <> 0 AND failed & (1 << k) <> 0), 0) AS redundant, coalesce(sum(n) FILTER (failed = 1 << k), 0) AS unique_fails,
    coalesce(sum(good) FILTER (failed & passed = 0 AND failed & (1 << k) <> 0), 0) AS good_lost, coalesce(sum(bad) FILTER (failed & passed = 0 AND failed & (1 << k) <> 0), 0) AS toxic_lost
  FROM s CROSS JOIN c GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM r
"""

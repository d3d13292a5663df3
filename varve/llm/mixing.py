"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sizes are counted once and sources dealt to hash shards, one for every SHARD_DOCS
documents of the source. Only sources' sizes and (source, shard) totals reach the driver:
a row for each source and one for each SHARD_DOCS documents. There each source's share
becomes a number of blocks, and each source's blocks become integer quotas per shard, both
by highest quotients size/(2k+1).

A shard lays its documents end to end in seeded order and cuts them into blocks. Its
quota is taken as whole rounds of all its blocks and then as many blocks as are left, by
a seeded order of the blocks: block j has rank (a * j + c) mod n, with a and n relatively
prime, and the least ranks are taken. What is less than a block is the beginning of the
next block in rank; words behind the last whole block come last. (A large shard's blocks
are bundles of up to BUNDLE words, so that a document meets few of them.)

Defined results: a null or wordless text has size 0 and takes 0; a null source is a
source of its own, last in order; repeated rows are documents of their own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varve.llm.common import WORD, table, written

WEIGHTS = (5.0, 2.0, 1.0)
#: Shards of a source: one for every SHARD_DOCS documents; below MIN_SHARDS of these, up to so many of SMALL_DOCS.
MIN_SHARDS, SMALL_DOCS, SHARD_DOCS = 8, 128, 1 << 20
MAX_REPEATS = 3
BUNDLE = 4096


def targets(sizes: list[int], weights: list[float], budget: float, most: float = MAX_REPEATS) -> list[float]:
    """Shares of budget by weight; each stops at most x its size, the excess reshared."""
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in sorted(full):
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in sorted(full))
        open_ = [i for i in open_ if i not in full]
    return out


def sainte_lague(votes: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by highest quotients votes/(2k+1); ties to the earlier entry.

    Starts from the seats that a slightly too large divisor gives every entry (all of
    them are among the highest quotients) and hands out the rest one at a time.
    """
    caps = caps or [seats] * len(votes)
    total, out = sum(votes), [0] * len(votes)
    if total <= 0 or seats <= 0:
        return out
    for i, v in enumerate(votes):
        out[i] = max(0, min(caps[i], int(v * max(0, seats - len(votes)) / total + 0.5) - 1))
    heap = [(-v / (2 * out[i] + 1), i) for i, v in enumerate(votes) if v > 0 and out[i] < caps[i]]
    heapq.heapify(heap)
    left = seats - sum(out)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        out[i] += 1
        left -= 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def stride(n: int) -> int:
    """A step near n by the golden ratio that is relatively prime to n."""
    a = max(1, round(n * 0.6180339887))
    while math.gcd(a, n) != 1:
        a += 1
    return a


def plan(totals: list[tuple], weights: tuple[float, ...] = WEIGHTS) -> list[tuple]:
    """totals: (source, shard, size). Returns (source, shard, source_size, target, words to
    take, shard size, words of a block, whole blocks, step of their order)."""
    by_source: dict = {}
    for source, shard, size in totals:
        by_source.setdefault(source, {})[shard] = size
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    sizes = [sum(by_source[s].values()) for s in order]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(order))], sum(sizes))
    positive = [t for t in goal if t > 0]
    # Blocks are small against the least target, so that whole blocks come near each.
    block = max(1, min(int(min(positive, default=1)) // 4096, BUNDLE))
    seats = sainte_lague(goal, round(sum(goal) / block), [int(MAX_REPEATS * s // block) for s in sizes])
    rows = []
    for i, s in enumerate(order):
        shards = sorted(by_source[s])
        held = [by_source[s][k] for k in shards]
        quota = sainte_lague([float(h) for h in held], seats[i], [int(MAX_REPEATS * h // block) for h in held])
        for k, h, q in zip(shards, held, quota, strict=True):
            bundle = block * max(1, min(BUNDLE, h // 256) // block)
            n = h // bundle
            rows.append((s, k, sizes[i], goal[i], q * block, h, bundle, n, stride(n) if n else 0))
    return rows


_PLAN = "q_source string, q_shard long, source_size long, target double, quota long, shard_size long, block long, n_blocks long, step long"


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 17, shard_docs: int = SHARD_DOCS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, source, shard, and how the words are taken:
    whole times the document, then its runs of words [a, b); text_hash."""
    spark = docs.sparkSession
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("draw"), F.xxhash64(F.col(text_col)).alias("text_hash"),
    )
    sized = written(sized, "sizes")
    n_docs = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.col("source").alias("n_source"), F.greatest(F.ceil(F.col("n") / shard_docs), F.least(F.lit(MIN_SHARDS), F.ceil(F.col("n") / SMALL_DOCS))).alias("n_shards"))
    dealt = sized.join(n_docs, F.col("source").eqNullSafe(F.col("n_source"))).withColumn("shard", F.pmod("draw", "n_shards")).drop("n_source", "n_shards")
    totals = dealt.groupBy("source", "shard").agg(F.sum("size").alias("size")).collect()
    quotas = spark.createDataFrame(plan([tuple(r) for r in totals], weights), _PLAN)
    in_shard = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "size", "text_hash")
    x = dealt.withColumn("stop", F.sum("size").over(in_shard.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    x = x.withColumns({"whole": F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(0).cast("long"), "start": F.col("stop") - F.col("size")})
    x = x.withColumn("rest", F.col("quota") - F.col("whole") * F.col("shard_size"))
    # Blocks that the shard takes whole, and words of the block next in rank.
    x = x.withColumn("n_full", F.least(F.floor(F.col("rest") / F.col("block")), "n_blocks"))
    x = x.withColumns({"part": F.col("rest") - F.col("n_full") * F.col("block"), "shift": F.when(F.col("n_blocks") > 0, F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.greatest("n_blocks", F.lit(1)))).otherwise(F.lit(0).cast("long"))})

    def run(j):
        """Words of block j (the last number stands for the words behind all blocks) that are taken of this document."""
        tail = j >= F.col("n_blocks")
        rank = F.when(tail, F.col("n_blocks")).otherwise(F.pmod(j * F.col("step") + F.col("shift"), F.greatest("n_blocks", F.lit(1))))
        take = F.when(rank < F.col("n_full"), F.col("block")).when(rank == F.col("n_full"), F.col("part")).otherwise(F.lit(0).cast("long"))
        lo = F.greatest("start", j * F.col("block"))
        hi = F.least("stop", j * F.col("block") + take)
        return F.struct((lo - F.col("start")).alias("a"), (F.greatest(lo, hi) - F.col("start")).alias("b"))

    def of(at):
        return F.least(F.floor(at / F.col("block")), "n_blocks").cast("long")

    runs = F.filter(F.transform(F.sequence(of(F.col("start")), of(F.col("stop") - 1)), run), lambda r: r["b"] > r["a"])
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    x = x.withColumn("runs", F.when((F.col("size") > 0) & (F.col("rest") > 0), runs).otherwise(none))
    words = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    return x.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + words).cast("long").alias("taken"), "source", "shard", "whole", "runs", "text_hash")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole time a document is
    taken, and one for each run of its words that is taken besides (text from the run's
    first word to its last; chars_col, if there is one, counts that text)."""
    takes = mix(docs, weights, seed, id_col=id_col, text_col=text_col, source_col=source_col).where("taken > 0")
    whole = F.transform(F.array_repeat("size", F.col("whole").cast("int")), lambda s: F.struct(F.lit(0).cast("long").alias("a"), s.alias("b")))
    # Rows that repeat id, source and text are one row here with the takes of all.
    takes = takes.groupBy("doc_id", "source", "text_hash").agg(F.flatten(F.collect_list(F.concat(whole, "runs"))).alias("__takes"), F.first("size").alias("__size"))
    takes = takes.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_hash").alias("__text"), "__takes", "__size")
    rows = docs.withColumn("__hash", F.xxhash64(text_col))
    match = (rows["__hash"] == takes["__text"]) & rows[id_col].eqNullSafe(takes["__id"]) & rows[source_col].eqNullSafe(takes["__source"])
    out = rows.dropDuplicates(["__hash", id_col, source_col]).join(takes, match).withColumn("__take", F.explode("__takes"))
    text = F.when((F.col("__take.a") == 0) & (F.col("__take.b") == F.col("__size")), F.col(text_col)).otherwise(_run_text(F.col(text_col), F.col("__take.a"), F.col("__take.b")))
    out = out.withColumn(text_col, text)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out.select(*docs.columns)


def _run_text(text: Column, a: Column, b: Column) -> Column:
    """Words a to b (b left out) of a text, joined by one space."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    return F.array_join(F.slice(words, (a + 1).cast("int"), (b - a).cast("int")), " ")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))

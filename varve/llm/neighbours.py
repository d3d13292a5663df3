"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes are BITS bits: vectors are centred, projected on their principal directions and
turned by rotations (as many as the bits ask for) that bring them near to the corners of
a cube (iterative quantisation), all learned on at most SAMPLE vectors. A code is cut into
PARTS substrings; each block of the index has a directory of the values of each substring
with the rows that have them. By the pigeonhole principle a code within radius r of a
query has a substring within r div PARTS (or one less) of the query's: probing the
directories retrieves every code within the radius, a full comparison keeps these, and
their original vectors are measured in double precision. A directory is probed by flipping
bits of the query's value, or, where it holds fewer values than there are flips, by
testing its values.

The radius is learned on the sample too: it holds RECALL of its true neighbours. All
rows are indexed. Blocks of queries meet blocks of the index, a task a pair, and each
pair returns its k nearest for each query, so no group of rows meets in one task. Blocks
grow with the table up to a bound, so that the index travels once for every
MAX_QUERY_BLOCK queries. Queries with fewer than k found are searched again without a
radius.

Defined results: vectors that are null, zero, of another length than most, or hold null
or non-finite components take no part, nor do rows with a null id; repeated vectors are
candidates each, ties go to the smaller id; a query's candidates leave out every row
with its own id; a query row that is repeated is one query, and an id with several
different vectors has a list for each of them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varve.llm.common import table, written

BITS, PARTS, SAMPLE, SAMPLE_QUERIES, RECALL = 256, 16, 20_000, 256, 0.98
MIN_BLOCK, MAX_INDEX_BLOCK, MAX_QUERY_BLOCK, K = 2048, 32_768, 16_384, 10
FOUND = "number long, query_id long, vec_id long, score double"


class Codes:
    """Projection, rotations and radius learned on a sample. A code is a row of 64-bit words."""

    def __init__(self, sample: np.ndarray, k: int, rounds: int = 25, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(axis=0)
        x, d = sample - self.mean, sample.shape[1]
        _, axes = np.linalg.eigh(x.T @ x)
        maps, width = [], min(d, BITS)
        for at in range(0, BITS, width):
            z, turn = x @ axes[:, ::-1][:, :width], np.linalg.qr(rng.normal(size=(width, width)))[0]
            for _ in range(rounds):
                u, _, v = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
                turn = (u @ v).T
            maps.append((axes[:, ::-1][:, :width] @ turn)[:, : BITS - at])
        self.map = np.hstack(maps)
        self.radius = self._radius(sample, k, rng)

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        bits = (vectors - self.mean) @ self.map > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")

    def _radius(self, x: np.ndarray, k: int, rng) -> int:
        code, gaps = self(x), []
        for i in rng.permutation(len(x))[:SAMPLE_QUERIES].tolist():
            far = ((x - x[i]) ** 2).sum(axis=1)
            far[i] = np.inf
            near = np.argsort(far, kind="stable")[: min(k, len(x) - 1)]
            gaps.append(apart(code[near], code[i]))
        gaps = np.concatenate(gaps) if gaps else np.zeros(0)
        return int(np.quantile(gaps, RECALL, method="higher")) if len(gaps) else BITS


def apart(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Bits that differ."""
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


def part_radii(radius: int) -> list[int]:
    """How far each substring may be: one of them is that near for any code in radius."""
    each, more = divmod(radius, PARTS)
    return [each if i <= more else each - 1 for i in range(PARTS)]


WIDTH = BITS // PARTS


def flips(radius: int) -> np.ndarray:
    """The masks of up to radius bits of a substring."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(WIDTH), r)], np.uint16)


def n_flips(radius: int) -> int:
    return sum(comb(WIDTH, r) for r in range(radius + 1))


class Index:
    """A block of codes: for each substring, its values and the rows that have them."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.parts, self.flips = codes, [], {}
        for p in codes.view("<u2").reshape(-1, PARTS).T:
            order = np.argsort(p, kind="stable")
            values, first = np.unique(p[order], return_index=True)
            self.parts.append((values, order, np.r_[first, len(p)]))

    def _near(self, values: np.ndarray, q: np.uint16, r: int) -> np.ndarray:
        """Places of the values within r bits of q."""
        if n_flips(r) >= len(values):
            return np.flatnonzero(np.bitwise_count(values ^ q) <= r)
        if r not in self.flips:
            self.flips[r] = flips(r)
        asked = self.flips[r] ^ q
        at = np.searchsorted(values, asked)
        at[at == len(values)] = 0
        return at[values[at] == asked]

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows that have a substring as near as the pigeonhole principle asks."""
        hit = np.zeros(len(self.codes), bool)
        mine = np.ascontiguousarray(code).view("<u2")
        for q, r, (values, order, first) in zip(mine, part_radii(radius), self.parts, strict=True):
            if r >= 0:
                near = self._near(values, q, r)
                size = first[near + 1] - first[near]
                stop = np.cumsum(size)
                hit[order[np.repeat(first[near] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]] = True
        return np.flatnonzero(hit)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows within radius of a code."""
        if radius >= BITS:
            return np.arange(len(self.codes))
        rows = self.probed(code, radius)
        return rows[apart(self.codes[rows], code) <= radius]


def _usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    x = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null")
    x = x.where(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("vec", lambda v: v != 0))
    return x


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["vec_id", "number"], kind="stable")
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "numbers": [pdf["number"].to_numpy(np.int64).tobytes()], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [np.stack(pdf["vec"].to_numpy()).astype(np.float64).tobytes()]})


def _blocks(rows: DataFrame, size: int | None) -> tuple[DataFrame, int]:
    count = rows.count()
    # Small tables are cut finer, so that every core gets some blocks.
    size = size or min(MAX_INDEX_BLOCK, max(MIN_BLOCK, count // (4 * rows.sparkSession.sparkContext.defaultParallelism)))
    n = max(1, -(-count // size))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(n)).cast("int"))
    return written(dealt.groupBy("block").applyInPandas(_block, "block int, numbers binary, ids binary, vectors binary"), "blocks"), n


def _search(codes, radius: int, k: int, dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = codes.value
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, vectors = np.frombuffer(r.ids, np.int64), np.frombuffer(r.vectors).reshape(-1, dim)
                q_numbers, q_ids, q_vectors = np.frombuffer(r.q_numbers, np.int64), np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.q_vectors).reshape(-1, dim)
                index, out = Index(make(vectors)), []
                for number, q, v, code in zip(q_numbers.tolist(), q_ids.tolist(), q_vectors, make(q_vectors), strict=True):
                    rows = index.within(code, radius)
                    rows = rows[ids[rows] != q]
                    far = np.sqrt(((vectors[rows] - v) ** 2).sum(axis=1))
                    if len(rows) > k:
                        cut = far <= np.partition(far, k - 1)[k - 1]
                        rows, far = rows[cut], far[cut]
                    best = np.lexsort((ids[rows], far))[:k]
                    out.append(pd.DataFrame({"number": number, "query_id": q, "vec_id": ids[rows[best]], "score": far[best]}))
                yield pd.concat(out) if out else pd.DataFrame({"number": [], "query_id": [], "vec_id": [], "score": []})

    return run


def nearest(rows: DataFrame, queries, k: int = K, sample_size: int = SAMPLE, index_block: int | None = None, query_block: int = MAX_QUERY_BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """queries: a condition on vec_id. Returns query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    usable = written(_usable(rows, id_col, vec_col).withColumn("number", F.monotonically_increasing_id()), "vectors")
    lengths = usable.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths.d
    usable = usable.where(F.size("vec") == dim)
    sample = usable.orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(sample_size).collect()
    codes = Codes(np.array([r.vec for r in sample]), k)
    shared = spark.sparkContext.broadcast(codes)
    index, n_index = _blocks(usable, index_block)
    # A query that stands twice is asked once; another vector under its id is another query.
    wanted = written(usable.where(queries).dropDuplicates(["vec_id", "vec"]), "queries")

    def search(these: DataFrame, radius: int) -> DataFrame:
        asked, n_asked = _blocks(these, query_block)
        asked = asked.select(F.col("block").alias("q_block"), F.col("numbers").alias("q_numbers"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
        # Pairs of block numbers, joined to either side by key.
        pairs = spark.range(n_index * n_asked).select((F.col("id") % n_index).cast("int").alias("block"), F.floor(F.col("id") / n_index).cast("int").alias("q_block"))
        work = pairs.join(index, "block").join(asked, "q_block").select("ids", "vectors", "q_numbers", "q_ids", "q_vectors")
        found = work.repartition(max(1, min(4096, n_index * n_asked))).mapInPandas(_search(shared, radius, k, dim), FOUND)
        rank = F.row_number().over(Window.partitionBy("number").orderBy("score", "vec_id"))
        return written(found.withColumn("rank", rank).where(F.col("rank") <= k).select("number", "query_id", "rank", "vec_id", "score"), "found")

    first = search(wanted, codes.radius)
    enough = first.where(F.col("rank") == k).select("number")
    short = written(wanted.join(enough, "number", "left_anti"), "short")
    if short.limit(1).count() == 0:
        return first.drop("number")
    again = search(short, BITS)
    return first.join(enough, "number", "left_semi").unionByName(again).drop("number")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)

"""SimHash fingerprints and their tiled exact comparison.

Fingerprints of whole texts are reduced to the distinct ones. Of bits cut into one band
more than the radius, two linked prints share at least one band whole. So each print goes
to one tile by each of its bands, and only prints of a tile with the same band are compared
there, by exclusive-or and bit counts in numpy. Bands that more than a tile of prints share
are compared as a whole: their prints are sorted by population count and cut into tiles of
a fixed size. Tile pairs whose population counts differ by more than the radius cannot hold
a link and are never made; each other pair of tiles is one small row (two byte strings).
Tiles return a spanning forest of their links, so a group of near copies costs its members
and not its pairs; the forests are joined by connected components.

Defined results: a null or wordless text has fingerprint zero and is linked like any
other; repeated rows share a component; an empty table gives an empty result; other
columns are ignored; a null doc_id is carried through and never names a component
unless its fingerprint has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm.common import small_batches, table, written
from varve.llm.components import components

SHINGLE, SEED, RADIUS, TILE = 3, 42, 3, 8192
#: Prints of a tile of one band, about; bits of a band at least; runs up to which prints are compared across all runs at once.
BAND_TILE, LEAST_BITS, SHORT = 4096, 8, 64
_SLICE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    starts = (np.concatenate(([0], ends[:-1]))).tolist()
    last = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(last)
    for at in range(0, n, _SLICE):
        h = np.fromiter((digest(view[s:e], seed) for s, e in zip(starts[at : at + _SLICE], last[at : at + _SLICE])), np.uint64, min(_SLICE, n - at))
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch["text"]], np.uint64)
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text_hash": batch["text_hash"], "print": prints.view(np.int64), "ones": np.bitwise_count(prints).astype(np.int32)})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, print (the fingerprint's bits as a long), ones (its population count)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInPandas(_fingerprints, "doc_id long, text_hash long, print long, ones int")


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = parent[x]
    while True:
        up = parent[r]
        if np.array_equal(up, r):
            return r
        r = up


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while len(i):
        a, b = _roots(parent, i), _roots(parent, j)
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if len(i):
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def forest(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in left followed by right) and roots of a spanning forest of the links."""
    n, m = len(left), len(right)
    parent = np.arange(n + m)
    if same:
        parent[n:] = np.arange(n)
    ones_l, ones_r = np.bitwise_count(left).astype(np.int16), np.bitwise_count(right).astype(np.int16)
    step = max(1, (1 << 21) // max(m, 1))
    for at in range(0, n, step):
        rows = slice(at, min(n, at + step))
        # Tiles are sorted by population count, so the rows' partners are one run.
        lo = np.searchsorted(ones_r, ones_l[rows].min() - radius, "left")
        hi = np.searchsorted(ones_r, ones_l[rows].max() + radius, "right")
        if lo >= hi:
            continue
        near = np.bitwise_count(left[rows, None] ^ right[None, lo:hi]) <= radius
        i, j = np.nonzero(near)
        _unite(parent, i + at, j + lo + n)
    all_ = np.arange(n if same else n + m)
    top = _roots(parent, all_)
    moved = top != all_
    return all_[moved], top[moved]


def _compare(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids = np.concatenate([np.frombuffer(r.ids_a, np.int64), np.frombuffer(r.ids_b, np.int64)])
                x, top = forest(np.frombuffer(r.prints_a, np.uint64), np.frombuffer(r.prints_b, np.uint64), radius, r.tile_a == r.tile_b)
                yield pd.DataFrame({"a": ids[x], "b": ids[top]})

    return run


def _tile(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["ones", "print"])
    return pd.DataFrame({"tile": [pdf["tile"].iloc[0]], "lo": [int(pdf["ones"].iloc[0])], "hi": [int(pdf["ones"].iloc[-1])], "ids": [pdf["node"].to_numpy(np.int64).tobytes()], "prints": [pdf["print"].to_numpy(np.int64).tobytes()]})


def bands(radius: int) -> list[tuple[int, int]]:
    """First bit and number of bits of each of radius + 1 bands."""
    ends = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def banded(prints: np.ndarray, first: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and roots of a spanning forest of the links between prints that share a band."""
    band = prints >> np.uint64(first) & np.uint64((1 << bits) - 1)
    order = np.lexsort((prints, np.bitwise_count(prints), band))
    x, band, parent = prints[order], band[order], np.arange(len(prints))
    start = np.flatnonzero(np.r_[True, band[1:] != band[:-1]]) if len(x) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(x)])
    # Of short runs, each print with the next of its run, then with the one after that, and so on.
    left = np.repeat(start + size, size) - np.arange(len(x))
    at, k = np.flatnonzero(np.repeat(size <= SHORT, size)), 1
    while len(at := at[left[at] > k]):
        near = at[np.bitwise_count(x[at] ^ x[at + k]) <= radius]
        _unite(parent, near, near + k)
        k += 1
    for a, n in zip(start[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
        i, top = forest(x[a : a + n], x[a : a + n], radius, True)
        parent[a + i] = a + top
    top = _roots(parent, np.arange(len(x)))
    moved = np.flatnonzero(top != np.arange(len(x)))
    return order[moved], order[top[moved]]


def _banded(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, (first, bits) = pdf["node"].to_numpy(np.int64), bands(radius)[int(pdf["band"].iloc[0])]
        x, top = banded(pdf["print"].to_numpy(np.int64).view(np.uint64), first, bits, radius)
        return pd.DataFrame({"a": nodes[x], "b": nodes[top]})

    return run


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """distinct: node, print, ones. Returns a, b: spanning forests of the links within radius."""
    cut = bands(radius)
    if min(bits for _, bits in cut) < LEAST_BITS:
        return tiled(distinct, radius, tile)
    count = distinct.count()
    of = [F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("print", a).bitwiseAND(F.lit((1 << n) - 1 if n < 64 else -1)).alias("value")) for k, (a, n) in enumerate(cut)]
    placed = distinct.select("*", F.explode(F.array(*of)).alias("of")).select("node", "print", "ones", "of.band", "of.value")
    # At most as many rows as bands have values, whatever the input; most inputs have none.
    hot = written(placed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).drop("n"), "hot")
    shared = None
    if hot.limit(1).count():
        shared = tiled(placed.join(hot, ["band", "value"], "left_semi").select("node", "print", "ones").distinct(), radius, tile)
        placed = placed.join(hot, ["band", "value"], "left_anti")
    placed = placed.select("node", "print", "band", F.pmod(F.xxhash64("value"), F.lit(max(1, -(-count // BAND_TILE)))).alias("tile"))
    found = placed.groupBy("band", "tile").applyInPandas(_banded(radius), "a long, b long")
    return found.union(shared) if shared is not None else found


def tiled(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """links() by comparing every pair of tiles that can hold one."""
    spark = distinct.sparkSession
    # How many prints each population count has: 65 rows, whatever the input.
    sizes = dict(distinct.groupBy("ones").count().collect())
    bounds, first, tiles = [], 0, []
    for ones in sorted(sizes):
        n = -(-sizes[ones] // tile)
        bounds.append((ones, first, n))
        tiles += [(first + i, ones) for i in range(n)]
        first += n
    if not tiles:
        return distinct.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    deal = spark.createDataFrame(bounds, "ones int, first int, n int")
    dealt = distinct.join(F.broadcast(deal), "ones").select("node", "print", "ones", (F.col("first") + F.pmod(F.xxhash64("print"), F.col("n"))).cast("int").alias("tile"))
    blobs = written(dealt.groupBy("tile").applyInPandas(_tile, "tile int, lo int, hi int, ids binary, prints binary"), "tiles")
    a = blobs.select(*[F.col(c).alias(f"{c}_a") for c in blobs.columns])
    b = blobs.select(*[F.col(c).alias(f"{c}_b") for c in blobs.columns])
    # The pairs of tiles to compare, as numbers: joined to the tiles by key, no cross join.
    pairs = spark.createDataFrame(tiles, "tile_a int, ones int").withColumn("to", F.explode(F.sequence(F.col("ones"), F.col("ones") + radius)))
    pairs = pairs.join(deal.select(F.col("ones").alias("to"), "first", "n"), "to").select("tile_a", F.explode(F.expr("sequence(first, first + n - 1)")).alias("tile_b")).where("tile_a <= tile_b")
    work = pairs.join(a, "tile_a").join(b, "tile_b").select("tile_a", "ids_a", "prints_a", "tile_b", "ids_b", "prints_b")
    n_tasks = max(1, min(4096, len(tiles)))
    return work.repartition(n_tasks).mapInPandas(_compare(radius), "a long, b long")


def _rooted(docs: DataFrame, radius: int, tile: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, print, root (a node of the row's component), component_id, text_hash of every row."""
    prints = written(fingerprints(docs, id_col, text_col), "prints")
    nodes = written(prints.groupBy("print", "ones").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("print")), "nodes")
    of = components(links(nodes, radius, tile).where("a <> b"))
    # A component is named by the smallest doc_id of its prints.
    named = nodes.join(of, "node", "left").select("print", "least", F.coalesce("component", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    out = named.join(least, "root").select("print", "root", "component_id")
    return prints.join(out, "print").select("doc_id", "print", "root", "component_id", "text_hash")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id, text_hash of every row."""
    found = _rooted(docs, radius, tile, id_col, text_col)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")


def keep_one(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with one row of each component: that of its
    smallest doc_id (of rows that repeat it, the one with the least hash of its text)."""
    # By root: the name is null of every component whose rows all lack an id.
    found = _rooted(docs, radius, TILE, id_col, text_col)
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    stay = written(stay.select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash")), "stay")
    rows = docs.withColumn("__row_hash", F.xxhash64(text_col))
    rows = rows.join(stay, rows["__row_hash"].eqNullSafe(stay["__hash"]) & rows[id_col].eqNullSafe(stay["__id"]), "left_semi")
    return rows.dropDuplicates(["__row_hash", id_col]).select(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

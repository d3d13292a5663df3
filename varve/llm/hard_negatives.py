"""Hard negatives of anchors by a two-dimensional block matrix multiplication.

Scores are integer inner products, so partial sums may be added in any order. Rows are
grouped by label, groups are cut into blocks, and blocks into chunks of dimensions;
anchors likewise. Tiles of scores stay where they are: a task owns a stripe of anchor blocks
and a stripe of row blocks, whose chunks are sent to it; for each pair of blocks it multiplies
them chunk by chunk and adds the products to one tile, as int64. The whole scores are reduced
at once: to the nearest rows of the anchor's label, or to the best rows of other labels
within each window that a positive's score opens. What leaves a task is a few rows an anchor,
and a ranking keeps the first of all tasks. No score, partial or whole, is shuffled or stored:
rows are sent once a stripe of anchors, and anchors once a stripe of rows. Stripes are of
megabytes, and so both are few.

Positives are searched only in pairs of blocks of one group, negatives in all pairs but
those of one single label, so the two passes together are about one full multiplication. A label that holds a
third of the rows fills many blocks, and labels of few rows share one.

Defined results: rows with a null id, label or vector, with a null or non-finite
component, or of another length than most take no part; rows that repeat whole count
once; of rows that differ under one id each is an anchor and a candidate by itself, and
none of an anchor's own id is its partner; ties go to the smaller id, then to the row
read first; an anchor without positives, and a positive without negatives,
has no row; an empty table gives an empty result; other columns are ignored. Sums beyond
64 bits wrap around as int64 does; a product of whole numbers goes through floating point
only where it stays exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varve.llm.common import table, written

#: Rows of a block, anchors of a block, dimensions of a chunk at least, chunks at most.
ROW_BLOCK, ANCHOR_BLOCK, CHUNK, MAX_CHUNKS = 4096, 256, 32, 8
POSITIVES, NEGATIVES = 5, 3
#: Numbers of a stripe of blocks, about; stripes of rows at least, if there are as many blocks.
STRIPE, MIN_STRIPES = 1 << 23, 24
#: Whole numbers below are exact in floating point.
_EXACT = {np.float32: 2.0**24, np.float64: 2.0**53}
#: A block: its name, group and rows, and by chunk the values; ids, labels and marks with the first.
BLOCK = "block string, group string, single boolean, n int, chunk int, ids binary, labels binary, numbers binary, marks binary, kind string, part binary"


def usable(rows: DataFrame, id_col: str, vec_col: str, label: Column, scale: float = 256.0) -> DataFrame:
    """vec_id, label, vec: whole numbers floor(scale * x), of the rows that take part, each once."""
    x = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    x = x.where("vec_id is not null and label is not null and v is not null").where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))))
    x = x.select("vec_id", "label", F.transform("v", lambda e: F.floor(e * F.lit(scale))).alias("vec")).dropDuplicates()
    return x


def grouped(rows: DataFrame, count: int, size: int) -> DataFrame:
    """Adds group and single. A label that fills a block is a group of its own; the others
    are dealt to groups of about a block by their hash."""
    full = rows.groupBy("label").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= size).select(F.col("label").alias("__label"))
    x = rows.join(full, rows["label"] == full["__label"], "left")
    dealt = F.concat(F.lit("s"), F.pmod(F.xxhash64("label"), F.lit(max(1, -(-count // size)))).cast("string"))
    single = F.col("__label").isNotNull()
    return x.withColumns({"group": F.when(single, F.concat(F.lit("l"), F.col("label").cast("string"))).otherwise(dealt), "single": single}).drop("__label")


def _blocks(rows: DataFrame, size: int, dim: int, tag: str) -> DataFrame:
    """rows: vec_id, label, vec, number, group, single, mark (binary). Each group in blocks of
    about size rows, each block in chunks of dimensions."""
    step = _step(dim)

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number", kind="stable")
        values, out = np.stack(pdf["vec"].to_numpy()).astype(np.int64), []
        kind = next(k for k in ("<i2", "<i4", "<i8") if _largest(values) < 2 ** (8 * int(k[2]) - 1) or k == "<i8")
        # Labels and hashes do not fill blocks evenly: what is over a block is cut again.
        for at in range(0, len(pdf), size):
            rows, part = pdf.iloc[at : at + size], values[at : at + size]
            fixed = {"block": f"{rows['place'].iloc[0]}/{at // size}", "group": rows["group"].iloc[0], "single": bool(rows["single"].iloc[0]), "n": len(rows)}
            for chunk, first in enumerate(range(0, dim, step)):
                head = {c: rows[s].to_numpy(np.int64).tobytes() if chunk == 0 else None for c, s in (("ids", "vec_id"), ("labels", "label"), ("numbers", "number"))}
                marks = b"".join(rows["mark"]) if chunk == 0 else None
                out.append(fixed | {"chunk": chunk} | head | {"marks": marks, "kind": kind, "part": np.ascontiguousarray(part[:, first : first + step]).astype(kind).tobytes()})
        return pd.DataFrame(out)

    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed("group", "__group")
    place = F.concat_ws("/", "group", F.pmod(F.xxhash64("number"), F.ceil(F.col("__n") / size)).cast("string"))
    x = rows.join(sizes, rows["group"] == sizes["__group"]).withColumn("place", place).drop("__n", "__group")
    return written(x.groupBy("place").applyInPandas(cut, BLOCK), tag)


def _step(dim: int) -> int:
    """Dimensions of a chunk."""
    return max(CHUNK, -(-dim // MAX_CHUNKS))


def _largest(x: np.ndarray) -> float:
    return max(float(x.max(initial=0)), -float(x.min(initial=0)))


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, as int64: in floating point where no partial sum can round."""
    most = _largest(a) * _largest(b) * a.shape[1]
    for kind, exact in _EXACT.items():
        if most < exact:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Block:
    """Rows of a block, and their numbers by chunk of dimensions."""

    def __init__(self, chunks: pd.DataFrame):
        chunks = chunks.sort_values("chunk")
        head = chunks.iloc[0]
        self.group, self.single, self.marks = head["group"], head["single"], head["marks"]
        self.ids, self.labels, self.numbers = (np.frombuffer(head[c], np.int64) for c in ("ids", "labels", "numbers"))
        self.parts = [np.frombuffer(p, k).reshape(head["n"], -1) for k, p in zip(chunks["kind"], chunks["part"], strict=True)]

    def scores(self, other: Block) -> np.ndarray:
        """A whole tile: its partial products are added where they are made."""
        out = np.zeros((len(self.ids), len(other.ids)), np.int64)
        for a, b in zip(self.parts, other.parts, strict=True):
            out += multiply(a, b)
        return out


def _first(score: np.ndarray, where: np.ndarray, b: Block, k: int) -> np.ndarray:
    """Of the places where, the k with the highest scores; ties by id, then number."""
    if len(where) > k:
        s = score[where]
        where = where[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return where[np.lexsort((b.numbers[where], b.ids[where], -score[where]))][:k]


FOUND = "anchor long, anchor_id long, positive int, positive_id long, positive_score long, other long, other_id long, score long"
_NAMES = [f.split()[0] for f in FOUND.split(", ")]


def _frame(rows: list[tuple], k: int) -> pd.DataFrame:
    """rows of FOUND: of each anchor and positive, the first k."""
    values = np.array(rows, np.int64).reshape(-1, len(_NAMES))
    x = {n: values[:, i] for i, n in enumerate(_NAMES)}
    order = np.lexsort((x["other"], x["other_id"], -x["score"], x["positive"], x["anchor"]))
    key = values[order][:, [_NAMES.index("anchor"), _NAMES.index("positive")]]
    start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(key)])
    order = order[np.arange(len(key)) - np.repeat(start, size) < k]
    return pd.DataFrame({n: v[order].astype(np.int32 if n == "positive" else np.int64) for n, v in x.items()})


def _positives(k: int):
    """Nearest rows of the anchors' labels, in blocks of their group."""

    def run(a: Block, b: Block) -> list[tuple]:
        if a.group != b.group:
            return []
        score, out = a.scores(b), []
        for i, (id_, label, number) in enumerate(zip(a.ids.tolist(), a.labels.tolist(), a.numbers.tolist(), strict=True)):
            where = np.flatnonzero((b.labels == label) & (b.ids != id_))
            out += [(number, id_, 0, 0, 0, b.numbers[j], b.ids[j], score[i, j]) for j in _first(score[i], where, b, k).tolist()]
        return out

    return run


def _negatives(k: int, low: int, high: int, width: int):
    """Nearest rows of other labels, in all blocks but those of the anchors' one label. width:
    positives of an anchor at most; its marks are their ids and scores."""

    def run(a: Block, b: Block) -> list[tuple]:
        if a.group == b.group and a.single:
            return []
        score, out = a.scores(b), []
        marks = np.frombuffer(a.marks, np.int64).reshape(len(a.ids), 1 + 2 * width)
        for i, (id_, label, number) in enumerate(zip(a.ids.tolist(), a.labels.tolist(), a.numbers.tolist(), strict=True)):
            apart = np.flatnonzero((b.labels != label) & (b.ids != id_))
            s = score[i, apart]
            for p in range(int(marks[i, 0])):
                p_id, p_score = marks[i, 1 + 2 * p : 3 + 2 * p].tolist()
                # Bounds in whole numbers: the scores themselves are not multiplied again.
                where = apart[(s >= -(-low * p_score // 100)) & (s <= high * p_score // 100)]
                out += [(number, id_, p, p_id, p_score, b.numbers[j], b.ids[j], score[i, j]) for j in _first(score[i], where, b, k).tolist()]
        return out

    return run


def _striped(blocks: DataFrame, name: str, stripe: int, least: int) -> tuple[DataFrame, int]:
    """blocks with the number of their stripe, blocks of one group side by side, and how many
    stripes there are."""
    heads = blocks.where("chunk = 0").select("block", F.row_number().over(Window.orderBy("group", "block")).alias("no"))  # one row a block
    count = heads.count()
    n = max(1, min(count, max(least, -(-count // max(1, stripe)))))
    return blocks.join(heads.select("block", F.floor((F.col("no") - 1) * n / max(1, count)).cast("int").alias(name)), "block"), n


def _multiplied(anchors: DataFrame, rows: DataFrame, reduce_, k: int, stripes: tuple[int, int]) -> DataFrame:
    """Scores of the pairs of blocks, reduced, by tasks of a stripe of anchors and one of rows.
    stripes: blocks in one, of anchors and of rows."""
    left, lines = _striped(anchors, "line", stripes[0], 1)
    right, columns = _striped(rows, "col", stripes[1], MIN_STRIPES)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        of_rows, found = [Block(x) for _, x in b.groupby("block")], []
        for _, x in a.groupby("block"):
            first = Block(x)
            found.append(_frame([row for other in of_rows for row in reduce_(first, other)], k))
        return pd.concat(found) if found else _frame([], k)

    # Tasks in a few of many partitions each, so that hardly two meet in one.
    sent = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(min(4096, 4 * lines * columns), "line", "col").groupBy("line", "col")
    return sent(left, "col", columns).cogroup(sent(right, "line", lines)).applyInPandas(run, FOUND)


def _ranked(found: DataFrame, k: int, tag: str) -> DataFrame:
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "other_id", "other")
    return written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), tag)


def mine(rows: DataFrame, anchors: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = 50, high: int = 95, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """rows: vec_id, label, vec (whole numbers), as usable() gives them. anchors: a condition
    on vec_id. For each anchor and each of its n_positives nearest rows of its label, the
    n_negatives nearest rows of other labels whose score lies between low and high per cent
    of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    held = written(rows.withColumn("number", F.monotonically_increasing_id()), "rows")
    lengths = held.groupBy(F.size("vec").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return none
    dim, count = lengths["d"], lengths["count"]
    stripes = STRIPE // (dim * anchor_block), STRIPE // (dim * row_block)
    held = written(grouped(held.where(F.size("vec") == dim), count, row_block), "grouped")
    asked, plain = held.where(anchors), F.lit(b"").alias("mark")
    blocks = _blocks(held.select("*", plain), row_block, dim, "row-blocks")
    first = _blocks(asked.select("*", plain), anchor_block, dim, "anchor-blocks")
    positives = _ranked(_multiplied(first, blocks, _positives(n_positives), n_positives, stripes), n_positives, "positives")
    # An anchor's positives travel with it, as whole numbers: how many, then ids and scores.
    marks = positives.groupBy(F.col("anchor").alias("number")).agg(F.sort_array(F.collect_list(F.struct("rank", "other_id", "score"))).alias("p"))
    width = 1 + 2 * n_positives

    @F.pandas_udf("binary")
    def packed(numbers: pd.Series) -> pd.Series:
        return numbers.map(lambda v: np.r_[np.asarray(v, np.int64), np.zeros(width - len(v), np.int64)].tobytes())

    flat = F.concat(F.array(F.size("p").cast("long")), F.flatten(F.transform("p", lambda r: F.array(r["other_id"], r["score"]))))
    second = _blocks(asked.join(marks.select("number", packed(flat).alias("mark")), "number"), anchor_block, dim, "marked-blocks")
    found = _ranked(_multiplied(second, blocks, _negatives(n_negatives, low, high, n_positives), n_negatives, stripes), n_negatives, "negatives")
    return found.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS alike, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""

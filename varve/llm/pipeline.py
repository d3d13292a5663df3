"""A training-corpus pipeline of five stages over documents.

Toxic documents go, equal texts and near-duplicates are reduced to one document, sources
are mixed to their weights, and what is left is packed into sequences. Each stage works
on all that its predecessor kept and returns the columns of documents; the last returns
the packed pieces.

Defined results, of every stage: a null text counts as empty, a null source is a source
of its own, rows with a null doc_id are rows like others (among copies they are kept
last); repeated rows are copies to the deduplicating stages and rows of their own to the
others; columns beyond those a stage reads are carried through unchanged, whatever their
names, up to packing, which ignores them; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import inspect
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from varve.llm import exact_dedup, mixing, packing, simhash, toxicity
from varve.llm.common import clear, delete, finished, marked, shared_dir, table, written_at


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below one half stay, ties at it go; an empty text has the bare
    offset's score. The model learns from the labels of the training folds."""
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays, one of those that repeat it."""
    index = exact_dedup.own_index(spark)
    try:
        return exact_dedup.keep_first(docs, index)
    finally:
        index.drop()


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the row with the smallest doc_id stays (of rows
    that repeat it, the one with the least hash of its text)."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, and the runs of words it takes besides; a
    document without words, or none of whose words are taken, goes."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows; repeated rows are documents of their own, and pieces of rows
    with one doc_id are told apart by their sequence and offset."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Scores, fingerprints and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Of what a run depends on: paths, sizes and times of its input files, and the code."""
    seen = hashlib.sha256()
    for name in ("documents", "labels"):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        found, files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True), []
        while found.hasNext():
            f = found.next()
            files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        seen.update(repr(sorted(files)).encode())
    for module in (exact_dedup, mixing, packing, simhash, toxicity, sys.modules[__name__]):
        seen.update(inspect.getsource(module).encode())
    return seen.hexdigest()[:24]


def home_of(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The folder of the stages of a named run: another for other input or other code."""
    return f"{shared_dir(spark)}/varve/pipeline-{name}-{_fingerprint(spark, sf_dir)}"


def forget(spark: SparkSession, sf_dir: str, name: str) -> None:
    """Deletes what a named run has left."""
    delete(home_of(spark, sf_dir, name), spark)


def run(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """The stages in turn. A stage is written to the shared folder and its predecessor, with
    all that it left there, deleted.

    A run that ended early, be it with its process, goes on under the same name behind its
    last finished stage, if its input and the code are still the same; its last stage stays
    until forget(). Without a name every run starts anew, and its stages go with the session."""
    home = home_of(spark, sf_dir, name) if name else f"{shared_dir(spark)}/varve/pipeline-{uuid.uuid4().hex}"
    paths = [f"{home}/{k}-{stage.replace(' ', '-')}" for k, (stage, _) in enumerate(STAGES[:-1])]
    done = max((k for k, path in enumerate(paths) if name and finished(spark, path)), default=-1)
    documents = table(spark, sf_dir, "documents")
    docs = spark.read.schema(documents.schema).parquet(paths[done]) if done >= 0 else documents
    before = marked()
    for k in range(done + 1, len(paths)):
        docs = written_at(STAGES[k][1](spark, docs, sf_dir), paths[k], keep=name is not None)
        # What the stage wrote on its way, and its predecessor: nothing reads them any more.
        clear(spark, before, but=paths[k])
        if name and k:
            delete(paths[k - 1], spark)
    return STAGES[-1][1](spark, docs, sf_dir)

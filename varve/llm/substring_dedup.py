"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the WINDOW - SEED + 1 runs of SEED words inside a window
of WINDOW words, the one with the least hash. A window's content alone decides its
anchor, so two documents that share a window share its anchor at the same offset.

1. Anchors of all documents (about a fifth of the words), reduced to least and greatest
   doc_id where they are made and then by anchor; those of two or more documents are the
   seeds. They become a Bloom filter of bounded size, broadcast. A filter too full for
   its bound lets more through and loses nothing: it only spares work.
2. Documents are joined on the seeds: each place of a seed goes, with the words around it
   that its windows reach, to the other places of that seed. There every window of a place
   is looked for, by its words, among those of smaller documents: how far a match extends
   to either side of a seed is the run of windows found, not a walk from the seed. Places that are equal as a whole need one look.
   Within a task equal windows, told by 128-bit hash, are settled before: a place travels only if one of its
   windows is that of the task's least document. Seeds at HOT places or more, whose places
   may be too many to meet, travel window by window under a 128-bit hash, reduced to the
   least document by aggregation and joined back, so no task sees them all.
3. Windows that a smaller doc_id holds too cover their words; overlapping windows make
   up the maximal repeats, whose words are removed.

Defined results: a null or empty text has 0 words and keeps the empty string; a null
doc_id is greater than any other; rows that repeat doc_id are one document to each
other, so they remove nothing from each other (texts that differ under one id are told
apart by 64-bit hash); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm.common import small_batches, table, written
from varve.llm.words import chunks, grams, mix, placed_words

WINDOW, SEED = 13, 5
CHUNK_BYTES = 4 << 20
#: The filter has FILTER_BITS bits a seed, and at most MAX_FILTER_BYTES in all.
FILTER_BITS, MAX_FILTER_BYTES, PROBES, SEGMENTS = 14, 64 << 20, 4, 64
#: Places of a seed from which on its windows travel one by one.
HOT = 10_000
_LAST = np.int64(2**63 - 1)
_RUN_BITS = 20


class Anchored:
    """Windows of a chunk of documents and the anchors they choose."""

    def __init__(self, texts: list[bytes | None], window: int, seed: int, second: bool = False):
        self.text, h, self.start, self.stop, *self.second = placed_words(texts, second)
        n, wide = len(h) - window + 1, window - seed + 1
        self.words = h
        if n <= 0:
            self.at = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.int64)
            self.seeds = np.zeros(0, np.uint64)
            return
        whole = self.text[: n] == self.text[window - 1 :]
        self.seeds = grams(h, seed)
        best, arg = self.seeds[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, wide):
            less = self.seeds[j : j + n] < best
            best[less] = self.seeds[j : j + n][less]
            arg[less] = j
        self.at = np.flatnonzero(whole)  # where windows start
        self.anchor = (self.at + arg[self.at]).astype(np.int64)  # where their anchors start


def _tag(text: bytes | None) -> int:
    return xxhash.xxh64_intdigest(text or b"") - (1 << 63)


def _ids(ids: list[int | None]) -> np.ndarray:
    return np.array([_LAST if i is None else i for i in ids], np.int64)


def _least(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by (keys, doc), starts of the keys in it, and least and greatest doc of each."""
    order = np.lexsort((doc, *keys))
    d, other = doc[order], np.zeros(max(len(doc) - 1, 0), bool)
    for k in keys:
        other |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(np.r_[True, other]) if len(doc) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(doc)] - 1 if len(doc) else first
    return order, first, d[first], d[last]


def _anchors(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, CHUNK_BYTES):
            a = Anchored(texts, window, seed)
            at = np.unique(a.anchor)
            h, doc = a.seeds[at], _ids(ids)[a.text[at]]
            order, first, lo, hi = _least((h,), doc)
            n = np.diff(np.r_[first, len(h)])
            back = np.argsort(order[first])  # in the order of the text: doc ids then pack well
            yield pa.record_batch({"h": h[order[first]][back].view(np.int64), "lo": lo[back], "hi": hi[back], "n": n[back]})

    return run


def _bits(h: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment, and the probed bits in it (one row a probe)."""
    a, b = mix(h), mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    return (a % np.uint64(SEGMENTS)).astype(np.int64), np.stack([((a >> np.uint64(8)) + np.uint64(i) * b) % np.uint64(n_bits) for i in range(PROBES)]).astype(np.int64)


def _segment(n_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((SEGMENTS, n_bits // 8), np.uint8)
        any_ = False
        for batch in batches:
            seg, bits = _bits(batch.column(0).to_numpy().view(np.uint64), n_bits)
            for b in bits:
                np.bitwise_or.at(held, (seg, b >> 3), (1 << (b & 7)).astype(np.uint8))
            any_ = any_ or len(seg) > 0
        if any_:
            used = np.flatnonzero(held.any(axis=1))
            yield pa.record_batch({"segment": used, "bits": pa.array([held[i].tobytes() for i in used], pa.binary())})

    return run


class SeedFilter:
    """Bloom filter of the seeds: at most MAX_FILTER_BYTES, whatever the input."""

    def __init__(self, n_bits: int, segments: dict[int, bytes]):
        self.n_bits = n_bits
        self.bits = np.zeros((SEGMENTS, n_bits // 8), np.uint8)
        for k, v in segments.items():
            self.bits[k] = np.frombuffer(v, np.uint8)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        seg, bits = _bits(h, self.n_bits)
        out = np.ones(len(h), bool)
        for b in bits:
            out &= (self.bits[seg, b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1
        return out


def seeds(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """h of the anchors that two or more documents hold, and n, their places. docs: doc_id, text."""
    found = docs.mapInArrow(_anchors(window, seed), "h long, lo long, hi long, n long")
    return found.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).where("lo < hi").select("h", "n")


def seed_filter(found: DataFrame) -> SeedFilter:
    """found: written, so that it is made once."""
    n = found.count()
    n_bits = max(64, min(MAX_FILTER_BYTES, n * FILTER_BITS // 8 + 8) * 8 // SEGMENTS // 64 * 64)
    filter_ = SeedFilter(n_bits, {})
    if n:
        dealt = found.select("h", F.pmod("h", F.lit(16)).alias("part")).repartition(16, "part").select("h")
        # Each of 16 tasks sends one filter; they are merged as they come.
        for r in dealt.mapInArrow(_segment(n_bits), "segment long, bits binary").toLocalIterator():
            filter_.bits[r.segment] |= np.frombuffer(r.bits, np.uint8)
    return filter_


def _runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts (as positions in at) and lengths of runs of next windows of a document."""
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])])
    return first, np.diff(np.r_[first, len(at)])


def _pieces(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, tag and spans of runs of windows."""
    start, length = _runs(text, pos)
    cut = [(s + k, min(1 << _RUN_BITS, n - k)) for s, n in zip(start.tolist(), length.tolist(), strict=True) for k in range(0, n, 1 << _RUN_BITS)]
    i, n = np.array([c[0] for c in cut], np.int64), np.array([c[1] for c in cut], np.int64)
    return doc[i], tag[i], (pos[i] << _RUN_BITS) + n - 1


def _places(shared, hot, window: int, seed: int):
    """Places of seeds that are not hot: key (the seed), doc, tag, span of the windows, and
    around, their words; and, with around null, spans that are settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, CHUNK_BYTES):
            texts = [b" ".join((t or b"").split()) for t in texts]
            w = _Windows(Anchored(texts, window, seed, True), shared.value, _ids(ids), len(texts), window)
            if not len(w.at):
                continue
            tag = np.array([_tag(t) for t in texts], np.int64)[w.text]
            if not w.open.all():
                done = ~w.open
                d, t, span = _pieces(w.doc[done], tag[done], w.pos[done], w.text[done])
                yield pa.record_batch({"key": mix((d.view(np.uint64) << np.uint64(20)) ^ span.view(np.uint64)).view(np.int64), "doc": d, "tag": t, "span": span, "around": pa.nulls(len(d), pa.binary())})
            cold = np.flatnonzero(w.open & ~hot.value(w.seed)) if len(w.at) else w.at
            if not len(cold):
                continue
            # Windows of one place of a seed follow one another: the first and the last of them.
            first = np.flatnonzero(np.r_[True, w.anchor[cold][1:] != w.anchor[cold][:-1]])
            a, b = cold[first], cold[np.r_[first[1:], len(cold)] - 1]
            data, begin, end = b"\n".join(texts), w.start[w.at[a]].tolist(), w.stop[w.at[b] + window - 1].tolist()
            yield pa.record_batch({
                "key": w.seed[a].view(np.int64), "doc": w.doc[a], "tag": tag[a], "span": (w.pos[a] << _RUN_BITS) + w.at[b] - w.at[a],
                "around": pa.array([data[i:j] for i, j in zip(begin, end, strict=True)], pa.binary()),
            })

    return run


class _Windows:
    """Windows of a chunk whose anchors are seeds; open: of the chunk's least document that has it."""

    def __init__(self, a: Anchored, filter_: SeedFilter, ids: np.ndarray, n_texts: int, window: int):
        places, back = np.unique(a.anchor, return_inverse=True)
        near = filter_(a.seeds[places])[back] if len(places) else np.zeros(0, bool)
        self.start, self.stop = a.start, a.stop
        self.at, self.anchor = a.at[near], a.anchor[near]
        self.seed, self.text = a.seeds[self.anchor] if len(self.at) else a.seeds[:0], a.text[self.at]
        self.doc = ids[self.text]
        self.pos = self.at - np.searchsorted(a.text, np.arange(n_texts))[self.text]
        if not len(self.at):
            self.open = np.zeros(0, bool)
            return
        self.h = grams(a.words, window)[self.at], grams(a.second[0], window)[self.at]
        order, first, lo, _ = _least(self.h, self.doc)
        least = np.empty(len(order), np.int64)
        least[order] = np.repeat(lo, np.diff(np.r_[first, len(order)]))
        # A window that stands twice in a document settles at both places.
        self.open = self.doc == least


def _hot_windows(hot, window: int, seed: int):
    """h1, h2 (128 bits of a window), doc, tag, span of the open windows of hot seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, CHUNK_BYTES):
            texts = [b" ".join((t or b"").split()) for t in texts]
            w = _Windows(Anchored(texts, window, seed, True), hot.value, _ids(ids), len(texts), window)
            k = np.flatnonzero(w.open)
            if len(k):
                tag = np.array([_tag(t) for t in texts], np.int64)[w.text[k]]
                yield pa.record_batch({"h1": w.h[0][k].view(np.int64), "h2": w.h[1][k].view(np.int64), "doc": w.doc[k], "tag": tag, "span": w.pos[k] << _RUN_BITS})

    return run


def _meet(window: int):
    """Rows sorted by key and doc. Spans of windows that a smaller document holds around the same seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, alike, least = None, {}, {}
        for batch in batches:
            keys, docs, tags, spans, around = (batch.column(i).to_pylist() for i in range(5))
            out: list[tuple[int, int, int]] = []
            for key, doc, tag, span, words in zip(keys, docs, tags, spans, around, strict=True):
                if words is None:
                    out.append((doc, tag, span))
                    continue
                if key != key_now:
                    key_now, alike, least = key, {}, {}
                elder = alike.setdefault(words, doc)
                if elder < doc:
                    # All of its windows are those of a smaller document.
                    out.append((doc, tag, span))
                    continue
                at, n = span >> _RUN_BITS, (span & ((1 << _RUN_BITS) - 1)) + 1
                each = words.split(b" ")
                for i in range(n):
                    if least.setdefault(tuple(each[i : i + window]), doc) < doc:
                        out.append((doc, tag, (at + i) << _RUN_BITS))
            if out:
                yield pa.record_batch(dict(zip(("doc", "tag", "span"), map(pa.array, zip(*out, strict=True), [pa.int64()] * 3), strict=True)))

    return run


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, hot_places: int = HOT) -> tuple[DataFrame, object]:
    """doc, tag, spans of windows that a smaller doc_id holds too; and the broadcast filter."""
    context = docs.sparkSession.sparkContext
    found = written(seeds(docs, window, seed), "seeds")
    frequent = found.where(F.col("n") >= hot_places)
    shared, hot = context.broadcast(seed_filter(found)), context.broadcast(seed_filter(frequent))
    places = docs.mapInArrow(_places(shared, hot, window, seed), "key long, doc long, tag long, span long, around binary")
    spans = places.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(_meet(window), "doc long, tag long, span long")
    if frequent.limit(1).count():
        rows = written(docs.mapInArrow(_hot_windows(hot, window, seed), "h1 long, h2 long, doc long, tag long, span long"), "hot")
        least = rows.groupBy("h1", "h2").agg(F.min("doc").alias("least"))
        spans = spans.unionByName(rows.join(least, ["h1", "h2"]).where("doc > least").select("doc", "tag", "span"))
    return spans.groupBy("doc", "tag").agg(F.collect_list("span").alias("spans")), shared


def _whole(shared, window: int, seed: int):
    """Each document as it is; its text goes along, packed, only if it holds a seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for ids, texts in chunks(batches, CHUNK_BYTES):
            a, filter_ = Anchored(texts, window, seed), shared.value
            places = np.unique(a.anchor)
            hit = set(a.text[places[filter_(a.seeds[places])]].tolist()) if len(places) else set()
            words = [(t or b"").split() for t in texts]
            yield pa.record_batch({
                "doc_id": pa.array(ids, pa.int64()), "doc": _ids(ids), "tag": np.array([_tag(b" ".join(w)) for w in words], np.int64),
                "n_words": np.array([len(w) for w in words], np.int64),
                "kept_sha256": pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words]),
                "packed": pa.array([pack(t) if i in hit else None for i, t in enumerate(texts)], pa.binary()),
            })

    return run


def covered_words(n_words: int, spans, window: int = WINDOW) -> np.ndarray:
    """True for each word that a window of the spans covers."""
    spans = np.asarray(spans, np.int64)
    start = spans >> _RUN_BITS
    stop = start + (spans & ((1 << _RUN_BITS) - 1)) + window
    change = np.bincount(start, minlength=n_words + 1) - np.bincount(stop, minlength=n_words + 1)
    return np.cumsum(change)[:n_words] > 0


def _strip(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            doc_id, n_words, sha, packed, spans = (batch.column(i) for i in range(5))
            sha, removed, kept_text = sha.to_pylist(), np.zeros(len(sha), np.int64), [None] * len(sha)
            for i in np.flatnonzero(~np.asarray(spans.is_null())).tolist():
                words = unpack(packed[i].as_py()).split()
                gone = covered_words(len(words), spans[i].values.to_numpy(), window)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                removed[i], sha[i] = gone.sum(), hashlib.sha256(kept).hexdigest()
                kept_text[i] = kept.decode() if with_text else None
            out = {"doc_id": doc_id, "n_words": n_words, "n_removed": removed, "kept_sha256": pa.array(sha, pa.string())}
            yield pa.record_batch(out | ({"kept_text": pa.array(kept_text, pa.string())} if with_text else {}))

    return run


def strip_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, hot_places: int = HOT, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row. With with_text also kept_text
    (kept words joined by a space) of the rows that lose words; others are null there."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spans, shared = repeats(docs, window, seed, hot_places)
    whole = docs.mapInArrow(_whole(shared, window, seed), "doc_id long, doc long, tag long, n_words long, kept_sha256 string, packed binary")
    joined = whole.join(spans, ["doc", "tag"], "left").select("doc_id", "n_words", "kept_sha256", "packed", "spans")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return joined.mapInArrow(_strip(window, with_text), out)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeats(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, list_aggregate(w[i : i + 12], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first_id FROM g) WHERE first_id < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM dup
), p AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n
  FROM p ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

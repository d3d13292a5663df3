"""Language-model scores from a log-frequency Bloom filter of bigram counts.

Training tokens are counted in numpy where they are read; what a task has counted goes on
as sorted, delta-coded and packed runs of 64-bit hashes, dealt to buckets by hash, so a
frequent bigram is one entry for each chunk of text and no bucket grows with it. Each
bucket sums its runs, quantises a count c to level 1 + floor(log c / log BASE) and puts
(bigram, 1) to (bigram, level) into a Bloom filter of its own. A probe asks for levels
1, 2, ... until one is missing: the last one found gives the count's lower edge.

The probability of w after v is s * count(v w) / count(v) + (1 - s) * (count(w) + 1) /
(N + V + 1), with s by the size class of count(v), fitted on all training texts as if each
of their own bigrams had been counted once less. The workers reduce these texts to numbers
of tokens by size class and quantised odds, a table of bounded size.

Filters of up to MAX_FILTER_BYTES in all, and counts of up to MAX_TOKENS distinct tokens,
are broadcast. Beyond either bound nothing is: the distinct tokens and bigrams of each
chunk of text go once, packed, with their counts to their buckets, which sum them, make
their filters and answer; the answers meet the chunk's tokens again and serve both the fit
and the scores. Chunks and buckets are of a size at which a chunk has hundreds of questions
for a bucket, so that work is in proportion to the text; no task holds more than a bucket's
questions or a chunk, and the scores are the same.

Defined results: a null text counts as empty and is the end token alone; a null doc_id
hashes as empty text (a training row); repeated rows are scored alike, a row each, and
each of them trains; an empty table gives an empty result; without training rows every
token has probability 1; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm.common import small_batches, table, written
from varve.llm.words import chunks, hashed_words, mix

FOLDS, HELD_OUT = 7, 2
BASE = 2**0.5
COUNT_BYTES, SCORE_BYTES, KEYED_BYTES = 4 << 20, 1 << 20, 8 << 20
#: A level sets PROBES bits of one 64-bit word; the filter has BITS bits a level.
PROBES, BITS = 4, 10
MAX_FILTER_BYTES, MAX_TOKENS = 128 << 20, 4_000_000
#: Bigrams (before summing) that one bucket takes; up to MAX_BUCKET_TOKENS where there would be more than MANY_BUCKETS.
BUCKET_TOKENS, MAX_BUCKET_TOKENS, MANY_BUCKETS = 500_000, 4_000_000, 256
_END, _START = np.uint64(0x5EED0E4D5EED0E4D), np.uint64(0x57A7275657A72756)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Cells of the fit: size classes; steps of the odds in an octave; the step of odds 1; steps, the last for a bigram not seen.
_CLASSES, _OCTAVE, _MID = 65, 16, 1024
_ODDS = 2 * _MID + 2


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(FOLDS) == HELD_OUT


def lower(texts: list[bytes | None]) -> list[bytes]:
    return [(t or b"").lower() for t in texts]  # bytes: A-Z alone


def token_stream(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and the hash before it (a start mark at first) of every token."""
    text, h = hashed_words(lower(texts))
    n = np.bincount(text, minlength=len(texts)) + 1
    ends = np.cumsum(n) - 1
    out = np.empty(len(h) + len(texts), np.uint64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = h, _END
    before = np.r_[_START, out[:-1]] if len(out) else out
    before[np.r_[0, ends[:-1] + 1]] = _START
    return np.repeat(np.arange(len(texts)), n), out, before


def _level_step(j: int) -> np.uint64:
    return np.uint64(j * int(_STEP) & 0xFFFFFFFFFFFFFFFF)


def pair(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(before * _STEP + h)


def pack_counts(key: np.ndarray, count: np.ndarray) -> bytes:
    """key sorted. Deltas byte by byte, so that the high zero bytes pack well."""
    delta = np.diff(key, prepend=np.uint64(0))
    return zstandard.compress(np.int64(len(key)).tobytes() + delta.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() + count.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def buckets(n_tokens: int) -> int:
    """As chunks have a row for each bucket, many small buckets cost chunks times buckets rows."""
    return max(8, min(n_tokens // BUCKET_TOKENS, max(MANY_BUCKETS, n_tokens // MAX_BUCKET_TOKENS)))


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    bytes_ = np.frombuffer(data, np.uint8, offset=8)
    delta = np.ascontiguousarray(bytes_[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(delta, dtype=np.uint64), np.ascontiguousarray(bytes_[8 * n :].reshape(4, n).T).view("<u4").ravel()


def _planes(x: np.ndarray) -> bytes:
    """Byte by byte, so that high zero bytes pack well."""
    return zstandard.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def _unplanes(blob: bytes, kind) -> np.ndarray:
    data = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(data.T).view(kind).ravel()


def _bucket(key: np.ndarray, n_buckets: int) -> np.ndarray:
    return key.view(np.int64) % np.int64(n_buckets)


def _by_bucket(key: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each key, and the order of buckets (that of the keys within one)."""
    bucket = _bucket(key, n_buckets)
    return bucket, np.argsort(bucket.astype(np.uint16) if n_buckets <= 1 << 16 else bucket, kind="stable")


def _tally(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(x, return_counts=True)


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in chunks(batches, COUNT_BYTES):
        key, n = _tally(token_stream(texts)[1])
        yield pa.record_batch({"h": key.view(np.int64), "n": n.astype(np.int64)})


def _count_pairs(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches, COUNT_BYTES):
            _, h, before = token_stream(texts)
            key, n = _tally(pair(before, h))
            bucket = _bucket(key, n_buckets)
            order = np.argsort(bucket, kind="stable")
            key, n, bucket = key[order], n[order], bucket[order]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            stop = np.r_[first[1:], len(key)]
            yield pa.record_batch({"bucket": bucket[first], "counts": pa.array([pack_counts(key[a:b], n[a:b]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)], pa.binary())})

    return run


def level(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / np.log(BASE) + 1e-9).astype(np.int64)


def edge(level_: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 of level 0."""
    return np.where(level_ > 0, np.ceil(BASE ** (np.maximum(level_, 1) - 1.0) - 1e-9), 0.0)


def _place(key: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word of each key among n_words, and the bits asked for in it."""
    x = mix(key)
    mask = np.uint64(1) << (x & np.uint64(63))
    for i in range(1, PROBES):
        mask |= np.uint64(1) << ((x >> np.uint64(6 * i)) & np.uint64(63))
    return (((x >> np.uint64(32)) * n_words) >> np.uint64(32)).astype(np.int64), mask


def _filter(key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The words of a filter of distinct keys."""
    if not len(key):
        return np.zeros(0, np.uint64)
    top = level(count)
    words = np.zeros(max(1, int(top.sum()) * BITS // 64), np.uint64)
    for j in range(1, int(top.max()) + 1):
        at, mask = _place(key[top >= j] + _level_step(j), np.uint64(len(words)))
        np.bitwise_or.at(words, at, mask)
    return words


def _bucket_filter(pdf: pd.DataFrame) -> pd.DataFrame:
    parts = [unpack_counts(b) for b in pdf["counts"]]
    key, count = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    key, count = key[first], np.add.reduceat(count, first)
    return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "bits": [_filter(key, count).tobytes()]})


def probe(words: np.ndarray, key: np.ndarray, base: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Levels found of each key in its filter, n_words from base on."""
    out, alive, j = np.zeros(len(key), np.uint8), np.flatnonzero(n_words > 0), 0
    key, base, n_words = key[alive], base[alive], n_words[alive]
    while len(alive):
        j += 1
        at, mask = _place(key + _level_step(j), n_words)
        hit = words[base + at] & mask == mask
        alive, key, base, n_words = alive[hit], key[hit], base[hit], n_words[hit]
        out[alive] = j
    return out


class PairFilter:
    """The filters of all buckets, end to end."""

    def __init__(self, n_buckets: int, sizes: list[tuple[int, int]], parts: Iterator[tuple[int, bytes]]):
        """sizes: bucket, bytes. parts come one by one, each written to its place."""
        self.n_words, self.base = np.zeros(n_buckets, np.uint64), np.zeros(n_buckets, np.int64)
        at = 0
        for bucket, size in sizes:
            self.n_words[bucket], self.base[bucket] = size // 8, at
            at += size // 8
        self.words = np.zeros(max(at, 1), np.uint64)
        for bucket, bits in parts:
            start = self.base[bucket]
            self.words[start : start + len(bits) // 8] = np.frombuffer(bits, np.uint64)
        self.n_buckets = n_buckets

    def __call__(self, key: np.ndarray) -> np.ndarray:
        """Levels found."""
        bucket = _bucket(key, self.n_buckets)
        return probe(self.words, key, self.base[bucket], self.n_words[bucket])


class Counts:
    """Counts of tokens; 0 of any other."""

    def __init__(self, h: np.ndarray, n: np.ndarray):
        order = np.argsort(h)
        self.h, self.n = h[order], n[order] if n.max(initial=0) >= 1 << 32 else n[order].astype(np.uint32)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), np.int64)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, key), len(self.h) - 1)
            hit = self.h[at] == key
            out[hit] = self.n[at[hit]]
        return out


class Totals:
    """Training tokens, distinct ones, and texts."""

    def __init__(self, n_tokens: int, n_distinct: int, n_docs: int):
        self.n_tokens, self.n_distinct, self.n_docs = n_tokens, n_distinct, n_docs
        self.room = float(n_tokens + n_distinct + 1)


class Chunk:
    """Some texts' distinct tokens and bigrams, in order, and where they stand."""

    def __init__(self, texts: list[bytes | None]):
        self.n_texts = len(texts)
        self.text, h, before = token_stream(texts)
        self.first = before == _START
        self.tokens, self.token_at = np.unique(h, return_inverse=True)
        self.pairs, self.pair_at = np.unique(pair(before, h), return_inverse=True)

    def counts(self, c_tokens: np.ndarray, levels: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every token: counts of the bigram (a level's least), of the token before, of the token."""
        return _counts(c_tokens[self.token_at], levels[self.pair_at], self.first, n_docs)


def _counts(c_token: np.ndarray, levels: np.ndarray, first: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c_before = np.r_[np.int64(0), c_token[:-1]]
    c_before[first] = n_docs
    return edge(np.arange(256))[levels], c_before, c_token


class Sizes:
    """Texts of which only the numbers of tokens are known."""

    def __init__(self, sizes: np.ndarray):
        self.n_texts, self.text = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
        self.first = np.cumsum(sizes) - sizes


def size_class(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, 1 + np.log2(np.maximum(count, 1)).astype(np.int64), 0)


def log_prob(shares: np.ndarray, c_pair: np.ndarray, c_before: np.ndarray, c_token: np.ndarray, room: float) -> np.ndarray:
    s = np.where(c_before > 0, shares[np.minimum(size_class(c_before), len(shares) - 1)], 0.0)
    return np.log10(s * np.minimum(c_pair, c_before) / np.maximum(c_before, 1) + (1 - s) * (c_token + 1) / room)


def fit_cells(c_pair: np.ndarray, c_before: np.ndarray, c_token: np.ndarray, room: float) -> np.ndarray:
    """Size class and quantised odds (one-token to bigram estimate) of every token whose
    history is left when the token itself is counted once less: all that the fit asks."""
    left = c_before - 1
    use = left > 0
    left, of = left[use], size_class(c_before[use])
    x = np.maximum(np.minimum(c_pair[use], c_before[use]) - 1, 0) / left
    odds = np.full(len(x), _ODDS - 1, np.int64)
    seen = x > 0
    steps = np.rint(_OCTAVE * np.log2(np.maximum(c_token[use][seen], 1) / room / x[seen])).astype(np.int64)
    odds[seen] = np.clip(steps + _MID, 0, 2 * _MID)
    return of * _ODDS + odds


def fit_shares(n_cell: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Share of the bigram estimate in each size class, by expectation maximisation over the
    numbers of tokens in each cell; classes with few tokens lean on the whole."""
    shares = np.full(_CLASSES, 0.5)
    cell = np.flatnonzero(n_cell)
    if not len(cell):
        return shares
    of, odds, n_of = cell // _ODDS, cell % _ODDS, n_cell[cell].astype(np.float64)
    ratio = np.where(odds < _ODDS - 1, 2.0 ** ((odds - _MID) / _OCTAVE), np.inf)
    n = np.bincount(of, n_of, _CLASSES)
    for _ in range(rounds):
        s = shares[of]
        post = n_of * s / (s + (1 - s) * ratio)
        whole = post.sum() / n_of.sum()
        shares = np.clip((np.bincount(of, post, _CLASSES) + 50 * whole) / (n + 50), 0.001, 0.95)
    return shares


def _rows(ids: list[int | None], chunk: Chunk, c_pair, c_before, c_token, shares: np.ndarray, room: float) -> pa.RecordBatch:
    add = lambda v: np.bincount(chunk.text, v, chunk.n_texts)
    return pa.record_batch({
        "doc_id": pa.array(ids, pa.int64()), "n_tokens": np.bincount(chunk.text, minlength=chunk.n_texts).astype(np.int64), "n_known": add(c_token > 0).astype(np.int64),
        "base_score": add(np.log10((c_token + 1) / room)), "score": add(log_prob(shares, c_pair, c_before, c_token, room)),
    })


_ROW = "doc_id long, n_tokens long, n_known long, base_score double, score double"
_CELL = "cell long, n long"


def _cell_rows(n_cell: np.ndarray) -> pa.RecordBatch:
    cell = np.flatnonzero(n_cell)
    return pa.record_batch({"cell": cell, "n": n_cell[cell]})


class Broadcast:
    """Counts and filters that every worker holds."""

    def __init__(self, counts, filters, training: DataFrame, rows: DataFrame, totals: Totals):
        self.counts, self.filters, self.training, self.rows, self.totals = counts, filters, training, rows, totals

    def chunks(self, batches: Iterator[pa.RecordBatch]):
        for ids, texts in chunks(batches, SCORE_BYTES):
            chunk = Chunk(texts)
            yield ids, chunk, chunk.counts(self.counts.value(chunk.tokens), self.filters.value(chunk.pairs), self.totals.n_docs)

    def over(self, train: bool) -> DataFrame:
        return self.training if train else self.rows

    def __getstate__(self):
        return {"counts": self.counts, "filters": self.filters, "totals": self.totals}


class Keyed:
    """Counts and filters that stay with their buckets: each chunk's questions go there,
    and the answers, kept by token, serve the fit and the scores."""

    def __init__(self, training: DataFrame, others: DataFrame, n_buckets: int, totals: Totals):
        self.totals = totals
        held = written(training.mapInArrow(_held(True), HELD).union(others.mapInArrow(_held(False), HELD)), "chunks")
        told = written(held.mapInArrow(_ask(n_buckets), ASKED).groupBy("bucket").applyInPandas(_answer(n_buckets), ASKED), "told")
        met = held.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(_meet(n_buckets), "train boolean, ids array<long>, sizes binary, c_tokens binary, levels binary")
        self.met = written(met, "met")

    def over(self, train: bool) -> DataFrame:
        """A row a chunk, of the training rows or of all."""
        return (self.met.where("train") if train else self.met).drop("train")

    def chunks(self, batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes, c_tokens, levels = (batch.column(k)[i].as_py() for k in range(4))
                chunk = Sizes(_unplanes(sizes, np.int64))
                yield ids, chunk, _counts(_unplanes(c_tokens, np.int64), _unplanes(levels, np.uint8), chunk.first, self.totals.n_docs)

    def __getstate__(self):
        return {"totals": self.totals}


#: A chunk: its rows' ids and numbers of tokens, its distinct tokens, and the ranks by frequency of those that stand in it.
HELD = "chunk long, train boolean, ids array<long>, sizes binary, tokens binary, token_at binary"
#: What a chunk asks a bucket, and what it is told.
ASKED = "bucket long, chunk long, tokens binary, pairs binary"


def _held(train: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, (ids, texts) in enumerate(chunks(batches, KEYED_BYTES)):
            text, h, _ = token_stream(texts)
            tokens, at, n_token = np.unique(h, return_inverse=True, return_counts=True)
            rank = np.empty(len(tokens), np.uint32)
            rank[_frequent(n_token)] = np.arange(len(tokens))
            column = lambda x: pa.array([x], pa.binary())
            yield pa.record_batch({
                "chunk": pa.array([(part << 32) + n], pa.int64()), "train": pa.array([train]), "ids": pa.array([ids], pa.list_(pa.int64())), "sizes": column(_planes(np.bincount(text, minlength=len(texts)))),
                "tokens": column(pack_counts(tokens, n_token)), "token_at": column(_planes(rank[at])),
            })

    return run


def _frequent(n_token: np.ndarray) -> np.ndarray:
    """Tokens in order of frequency: ranks pack better than places."""
    return np.argsort(-n_token.astype(np.int64), kind="stable")


def _unheld(sizes: bytes, tokens: bytes, token_at: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens and their counts, which of them stand where, and the bigram at each place."""
    tokens, n_token = unpack_counts(tokens)
    at = _frequent(n_token)[_unplanes(token_at, np.uint32)]
    h, sizes = tokens[at], _unplanes(sizes, np.int64)
    before = np.r_[_START, h[:-1]]
    before[np.cumsum(sizes) - sizes] = _START
    return tokens, n_token, at, pair(before, h)


def _ask(n_buckets: int):
    def runs(key: np.ndarray, n: np.ndarray) -> list[bytes]:
        """By bucket, keys as multiples of n_buckets, which are shorter, with their counts."""
        bucket, order = _by_bucket(key, n_buckets)
        ends = np.cumsum(np.bincount(bucket, minlength=n_buckets))
        whole, n = (key.view(np.int64)[order] // n_buckets).view(np.uint64), n[order]
        return [pack_counts(whole[i:j], n[i:j]) for i, j in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk_id, train, _, *held = (batch.column(k)[i].as_py() for k in range(6))
                tokens, n_token, _, pairs = _unheld(*held)
                pairs, n = _tally(pairs)
                # Rows to score only are asked about, and not counted.
                asked = runs(tokens, train * n_token), runs(pairs, train * n)
                yield pa.record_batch({"bucket": np.arange(n_buckets), "chunk": np.full(n_buckets, chunk_id), "tokens": pa.array(asked[0], pa.binary()), "pairs": pa.array(asked[1], pa.binary())})

    return run


def _answer(n_buckets: int):
    """Sums a bucket's runs, and answers each of them in its order."""

    def summed(runs: pd.Series, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = [unpack_counts(b) for b in runs]
        key = (np.concatenate([p[0] for p in parts]).view(np.int64) * n_buckets + bucket).view(np.uint64)
        key, at = np.unique(key, return_inverse=True)
        return key, np.bincount(at, np.concatenate([p[1] for p in parts]), len(key)).astype(np.int64), at, np.cumsum([len(p[0]) for p in parts])[:-1]

    def run(asked: pd.DataFrame) -> pd.DataFrame:
        bucket = int(asked["bucket"].iloc[0])
        _, c_tokens, at, ends = summed(asked["tokens"], bucket)
        tokens = [_planes(x) for x in np.split(c_tokens[at], ends)]
        key, n, at, ends = summed(asked["pairs"], bucket)
        words = _filter(key[n > 0], n[n > 0])
        levels = probe(words, key, np.zeros(len(key), np.int64), np.full(len(key), len(words), np.uint64))
        return pd.DataFrame({"bucket": asked["bucket"], "chunk": asked["chunk"], "tokens": tokens, "pairs": [_planes(x) for x in np.split(levels[at], ends)]})

    return run


def _meet(n_buckets: int):
    def spread(key: np.ndarray, told: pd.Series, kind) -> np.ndarray:
        out = np.empty(len(key), kind)
        out[_by_bucket(key, n_buckets)[1]] = np.concatenate([_unplanes(b, kind) for b in told])
        return out

    def run(held: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told, row = told.sort_values("bucket"), held.iloc[0]
        tokens, _, at, pairs = _unheld(row["sizes"], row["tokens"], row["token_at"])
        pairs, pair_at = np.unique(pairs, return_inverse=True)
        c_tokens, levels = spread(tokens, told["tokens"], np.int64)[at], spread(pairs, told["pairs"], np.uint8)[pair_at]
        return held[["train", "ids", "sizes"]].assign(c_tokens=[_planes(c_tokens)], levels=[_planes(levels)])

    return run


def _cells(lookup):
    """Numbers of tokens by cell, a few rows for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_cell = np.zeros(_CLASSES * _ODDS, np.int64)
        for _, _, counts in lookup.chunks(batches):
            n_cell += np.bincount(fit_cells(*counts, lookup.totals.room), minlength=len(n_cell))
        yield _cell_rows(n_cell)

    return run


def _score(lookup, shares: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, chunk, counts in lookup.chunks(batches):
            yield _rows(ids, chunk, *counts, shares, lookup.totals.room)

    return run


def lm_score(docs: DataFrame, train, max_tokens: int = MAX_TOKENS, max_filter_bytes: int = MAX_FILTER_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row; train is
    the condition on the rows to learn from; the shares are fitted on all of these rows."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    training = docs.where(train).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = written(training.mapInArrow(_count_tokens, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "tokens")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("h") == int(np.array(_END).view(np.int64)), F.col("n"))), F.lit(0))).first()
    totals = Totals(*(int(v) for v in total))
    n_buckets = buckets(totals.n_tokens)
    keyed = totals.n_distinct > max_tokens
    if not keyed:
        runs = training.mapInArrow(_count_pairs(n_buckets), "bucket long, counts binary")
        filters = written(runs.groupBy("bucket").applyInPandas(_bucket_filter, "bucket long, bits binary"), "filters")
        keyed = filters.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0] > max_filter_bytes
    if keyed:
        others = docs.where(~F.coalesce(train, F.lit(False))).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        lookup = Keyed(training, others, n_buckets, totals)
    else:
        # Both are of a checked size, and so is the number of buckets: each holds millions of bigrams.
        sizes = sorted((r.bucket, r.size) for r in filters.select("bucket", F.length("bits").alias("size")).collect())
        hot = counts.toArrow()
        known = context.broadcast(Counts(hot["h"].to_numpy().view(np.uint64), hot["n"].to_numpy()))
        del hot
        lookup = Broadcast(known, context.broadcast(PairFilter(n_buckets, sizes, ((r.bucket, r.bits) for r in filters.toLocalIterator()))), training, rows, totals)
    # As many rows as there are cells in use, whatever the input.
    n_cell = np.zeros(_CLASSES * _ODDS, np.int64)
    for r in lookup.over(True).mapInArrow(_cells(lookup), _CELL).groupBy("cell").agg(F.sum("n").alias("n")).collect():
        n_cell[r.cell] = r.n
    out = lookup.over(False).mapInArrow(_score(lookup, fit_shares(n_cell)), _ROW)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(totals.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_score(docs, ~held_out("doc_id"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

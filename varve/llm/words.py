"""Words of many texts at once, as 64-bit numbers in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def placed_words(texts: list[bytes | None], second: bool = False) -> tuple[np.ndarray, ...]:
    """Number of the text, hash, start and stop (in the texts joined by a line feed) of each
    word, in order; with second also another hash. Whole texts, any length."""
    texts = [t or b"" for t in texts]
    # One break after each text, and eight bytes more so that every load stays inside.
    data = np.frombuffer(b"\n".join(texts) + b"\n" + b"\n" * 8, np.uint8)
    is_word = _IS_WORD[data]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    if is_word[0]:
        edge = np.r_[0, edge]
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(bounds, start, "right")
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))

    def load(at, n):
        n = np.minimum(n, 8)
        return eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * n.astype(np.uint64)))

    first = load(start, size)
    hashes = [mix(first + size.astype(np.uint64) * _A)] + ([mix((first ^ _C) * _B + size.astype(np.uint64))] if second else [])
    more, done = np.flatnonzero(size > 8), 8
    while len(more):
        next_ = load(start[more] + done, size[more] - done)
        for h, by in zip(hashes, (_A, _C)):
            h[more] = mix(h[more] * by + next_)
        done += 8
        more = more[size[more] > done]
    return text, hashes[0], start, start + size, *hashes[1:]


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and hash of each word, in order."""
    return placed_words(texts)[:2]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; shorter by n - 1 than h."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        out = out * _A + h[i : i + len(out)]
    return mix(out)


def chunks(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[tuple[list[int | None], list[bytes | None]]]:
    """Ids and texts of whole documents, regrouped into chunks of about max_bytes."""
    ids: list[int | None] = []
    texts: list[bytes | None] = []
    held = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            held += len(t or b"") + 1
            if held >= max_bytes:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts

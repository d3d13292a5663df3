"""Packing documents into sequences: first-fit decreasing over a tournament tree.

Documents are tokenised where they are read; only lengths and checksums travel on. A
document is cut at multiples of the sequence length: its whole pieces are sequences of
their own and its last piece is packed. Documents are dealt to groups of about
GROUP_DOCS at random (seeded by doc_id), and each group is packed on its own, so a task
holds one group's lengths whatever the input's size.

The ids are those of the ``tokenizers`` file. Where the file says that its ids follow the
order of its merges and that it splits by the byte-level pattern and nothing else, its
vocabulary is run by ``tiktoken``, several times as fast, with the same result; each
worker compares both on the first texts it meets all the same, and goes on with
``tokenizers`` alone if they differ. So it does with any other file, and with texts that
hold a special token's string, that fail there, or that hold letters of the later planes
(the two libraries may know different versions of Unicode).

Defined results: a null or empty text is the single end id; repeated rows are documents
of their own, in an order fixed by their content, and dealt to groups by their number, so
a row that repeats without end fills no group; an empty table gives an empty result;
other columns are ignored; a null doc_id is packed like any other.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm.common import small_batches, table

LENGTH, END_ID, GROUP_DOCS, SEED = 1024, 0, 8192, 29
#: Rows of a task whose repeats are numbered, before the count starts anew.
_MAX_SEEN = 200_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tokens:
    """Ids of whole texts by a byte-level BPE file of the ``tokenizers`` library."""

    #: The byte-level alphabet keeps these bytes as they are; the others,
    #: in order, are written as the code points from 256 on.
    KEPT = (*range(33, 127), *range(161, 173), *range(174, 256))
    #: Fixed value: the file's splitting pattern.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.fast, self.checks = None, 8
        if self.same_by_design(spec):
            rest = [b for b in range(256) if b not in set(self.KEPT)]
            byte = {chr(b): b for b in self.KEPT} | {chr(256 + i): b for i, b in enumerate(rest)}
            ranks = {bytes(byte[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in set(self.special)}
            self.fast = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def same_by_design(self, spec: dict) -> bool:
        """Byte-level splitting alone, and ids in the order of the merges."""
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or spec.get("normalizer") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("dropout"):
            return False
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            return False
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"].get("".join(m), -1) for m in pairs]
        return len(set(made)) == len(made) and all(x < y for x, y in zip(made, made[1:])) and len(made) + 256 == len(set(model["vocab"]) - set(self.special))

    def _slowly(self, text: str) -> np.ndarray:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special) or (not text.isascii() and max(text) >= "\U00010000"):
            return self._slowly(text)
        try:
            ids = self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        except BaseException as failed:  # the library's own panics are no Exceptions
            if isinstance(failed, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self._slowly(text)
        if self.checks and text:
            self.checks -= 1
            other = self._slowly(text)
            if not np.array_equal(ids, other):
                self.fast = None
                return other
        return ids


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def _measure(path: str, length: int, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end, seen = tokens(path), np.array([end_id], "<u4"), {}
        for batch in batches:
            sizes, crcs, copies = [], [], []
            if len(seen) > _MAX_SEEN:
                seen.clear()
            for key in zip(batch["doc_id"].fillna(-1).tolist(), (zlib.crc32(t.encode("utf-8", "surrogatepass")) if t else 0 for t in batch["text"]), strict=True):
                seen[key] = seen.get(key, -1) + 1
                copies.append(seen[key])
            for text in batch["text"]:
                ids = np.concatenate([encode(text), end]) if text else end
                data = memoryview(ids.tobytes())
                sizes.append(len(ids))
                crcs.append([zlib.crc32(data[4 * i : 4 * (i + length)]) for i in range(0, len(ids), length)])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "doc_tokens": sizes, "crcs": crcs, "copy": copies})

    return run


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size. A tournament tree holds the most free room below each node,
    so the first bin with room is found by one walk from the root."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    out = [0] * len(sizes)
    for i in order:
        size, at = sizes[i], 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        out[i] = at - leaves
        room[at] -= size
        at //= 2
        while at:
            left, right = room[2 * at], room[2 * at + 1]
            best = left if left >= right else right
            if room[at] == best:
                break
            room[at] = best
            at //= 2
    return out


def pack_group(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    pdf = pdf.assign(key=[tuple(map(int, c)) for c in pdf["crcs"]]).sort_values(["doc_id", "doc_tokens", "key"], kind="stable", na_position="last")
    total = pdf["doc_tokens"].to_numpy(np.int64)
    n_pieces = -(-total // length)
    row = np.repeat(np.arange(len(pdf)), n_pieces)
    number = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    start = number * length
    size = np.minimum(length, total[row] - start)
    # A whole piece fills a sequence: only the rest need the tree.
    part = np.flatnonzero(size < length)
    bins = np.array(first_fit_decreasing(size[part].tolist(), length), np.int64)
    n_bins = int(bins.max()) + 1 if len(bins) else 0
    sequence, offset = np.empty(len(row), np.int64), np.zeros(len(row), np.int64)
    sequence[part] = bins
    sequence[size == length] = n_bins + np.arange(len(row) - len(part))
    by_bin = part[np.argsort(bins, kind="stable")]
    ends = np.cumsum(size[by_bin])
    before = ends - size[by_bin]
    first = np.r_[True, np.diff(sequence[by_bin]) != 0] if len(by_bin) else np.zeros(0, bool)
    offset[by_bin] = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(by_bin)]))
    return pd.DataFrame({
        "doc_id": pdf["doc_id"].astype("Int64").to_numpy()[row] if pdf["doc_id"].isna().any() else pdf["doc_id"].to_numpy(np.int64)[row],
        "start": start, "length": size, "ids_crc32": np.concatenate([np.array(k, np.int64) for k in pdf["key"]]),
        "doc_tokens": total[row], "sequence_id": (int(pdf["part"].iloc[0]) << 32) + sequence, "offset": offset,
    })


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, group_docs: int = GROUP_DOCS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_groups = max(1, round(docs.count() / group_docs))
    sized = docs.mapInPandas(_measure(tokenizer, length, end_id), "doc_id long, doc_tokens long, crcs array<long>, copy long")
    dealt = sized.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_tokens", "crcs", "copy"), F.lit(n_groups)))
    return dealt.groupBy("part").applyInPandas(lambda pdf: pack_group(pdf, length), PIECES)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

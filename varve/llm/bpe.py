"""Byte-pair encoding and decoding by a tokenizer file.

A text is split at the file's special tokens, normalised (NFC, white space, lower case)
and cut into words by the file's pattern; each word is a doubly linked list of symbols,
and a queue holds the neighbours that have a merge, by its rank and then by place. The
least is taken out, passed over if its symbols have changed since, and else merged; the
merged symbol's new neighbours enter the queue. So a word of n bytes takes O(n log n),
however long it is. White space ends every word: what lies between is remembered by each
worker, up to a number, long ones never.

Python and the file's library may know different versions of Unicode. A stretch of text
that holds a code point which Python's version does not assign, or a mark that only
Python's puts in order, is therefore normalised and cut into words by the file's own
normaliser and splitter; its words are merged here.

Decoding looks up every id in the vocabulary and joins the strings, as the library does
for a file without a decoder: by one space.

Defined results: a null or empty text has no ids and decodes to the empty string; rows
are independent, so repeated rows and ids give repeated results; an empty table gives an
empty result; columns that are not asked for are ignored; an id outside the vocabulary is
left out, as by the library.
"""

from __future__ import annotations

import heapq
import json
import struct
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm.common import small_batches, table
from varve.llm.packing import Tokens

#: Runs of characters between white space that a worker remembers, and the longest of them.
MAX_CHUNKS, MAX_LENGTH = 800_000, 64
#: More than the symbols of any word.
PLACES = 1 << 40


class Merges:
    """The merges of a file, as ids."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        #: For each id, what may follow it: that id to the merge's rank, times PLACES.
        self.rank: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        for rank, (a, b) in enumerate(pairs):
            self.rank[vocab[a]][vocab[b]] = rank * PLACES
        #: By rank times PLACES, the id that the merge makes.
        self.made = {rank * PLACES: vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        rest = [b for b in range(256) if b not in set(Tokens.KEPT)]
        letter = {b: chr(b) for b in Tokens.KEPT} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.inner, self.end = [vocab[letter[b]] for b in range(256)], [vocab[letter[b] + suffix] for b in range(256)]

    def merge(self, ids: list[int]) -> list[int]:
        """Merges neighbours in the order of rank, then place; an entry of the queue is both
        in one number. Writes into ids."""
        n, rank = len(ids), self.rank
        queue = [rank[a][b] + at for at, (a, b) in enumerate(zip(ids, ids[1:])) if b in rank[a]]
        if not queue:
            return ids
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        before, after, made = list(range(-1, n - 1)), [*range(1, n), -1], self.made
        while queue:
            entry = pop(queue)
            at = entry % PLACES
            left, right = ids[at], after[at]
            # Stale: either symbol has been merged since, so the pair is gone or has another rank.
            if left < 0 or right < 0 or rank[left].get(ids[right]) != entry - at:
                continue
            ids[at] = new = made[entry - at]
            ids[right] = -1
            after[at] = far = after[right]
            if far >= 0:
                before[far] = at
                if (level := rank[new].get(ids[far])) is not None:
                    push(queue, level + at)
            near = before[at]
            if near >= 0 and (level := rank[ids[near]].get(new)) is not None:
                push(queue, level + near)
        return [i for i in ids if i >= 0]

    def ids(self, word: str) -> list[int]:
        data, inner = word.encode("utf-8", "surrogatepass"), self.inner
        found = [inner[b] for b in data]
        found[-1] = self.end[data[-1]]
        return self.merge(found)


class Chunks(dict):
    """Run of characters between white space to its ids, as little-endian unsigned 32-bit
    numbers. When full, what was not asked for since it was half full is forgotten."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.older, self.words = bpe, {}, {}

    def __missing__(self, chunk: str) -> bytes:
        out = self.older.get(chunk)
        if out is None:
            ids, words = [], self.words
            for word in self.bpe.split(chunk):
                if len(word) > 2:
                    ids += self.bpe.merges.ids(word)
                    continue
                # Mostly punctuation: few words, all of them met again and again.
                if (found := words.get(word)) is None:
                    words[word] = found = self.bpe.merges.ids(word)
                ids += found
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= MAX_LENGTH:
            if len(self) >= MAX_CHUNKS // 2:
                self.older, self.words = dict(self), {}
                self.clear()
            self[chunk] = out
        return out


class Bpe:
    """Encoder and decoder of one file. Files with other parts than those here are refused."""

    #: The code points that the file's normaliser reads as white space.
    SPACES = regex.compile("[\t-\r \x85\xa0  -     　]+")

    #: What Python takes for white space besides.
    SPLITS = regex.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        known = (
            [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
            and (split["type"], split["behavior"], split["invert"]) == ("Split", "Removed", True) and (level["type"], level["add_prefix_space"], level["use_regex"]) == ("ByteLevel", False, False)
            and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) and not spec["decoder"]
            and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        )
        if not known:
            raise ValueError(f"{path} is no file of the kind that is read here")
        lib = Tokenizer.from_file(path)
        self.normalizer, self.splitter = lib.normalizer, lib.pre_tokenizer
        self.words = regex.compile(split["pattern"]["Regex"])
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        strings = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.strings = [strings.get(i) for i in range(max(strings) + 1)]
        self.byte = {c: bytes([b]) for b, c in ({b: chr(b) for b in Tokens.KEPT} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(Tokens.KEPT))}).items()}
        self.assigned: set[str] = set()
        # Marks that Python orders and the file's normaliser does not know to order.
        marks = (chr(c) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c)))
        self.moved = {c for c in marks if unicodedata.normalize("NFC", f"q\u0345{c}") != self.normalizer.normalize_str(f"q\u0345{c}")}
        self.chunks = Chunks(self)

    def _known(self, text: str) -> bool:
        """Both versions of Unicode agree on all that the text holds."""
        if text.isascii():
            return True
        new = set(text) - self.assigned
        if any(unicodedata.category(c) == "Cn" for c in new) or not self.moved.isdisjoint(new):
            return False
        self.assigned |= new
        return True

    def split(self, text: str) -> list[str]:
        """Words of a stretch without special tokens."""
        if text.isascii() and text.isalpha():
            return [text.lower()]
        if self._known(text):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            # Letters are lowered one by one: no other form of sigma at a word's end. White space
            # need not become one space, as no word holds any.
            return self.words.findall(text.replace("Σ", "σ").lower())
        levelled = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [b"".join(self.byte[c] for c in word).decode("utf-8") for word, _ in levelled]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers. No word holds white space and nothing
        composes across it, so what lies between is encoded, and remembered, by itself."""
        if not text:
            return b""
        out = []
        for piece in self.at_special.split(text) if self.at_special else [text]:
            if piece in self.special:
                out.append(self.special[piece])
            else:
                out.extend(map(self.chunks.__getitem__, piece.split() if self.SPLITS.search(piece) is None else self.SPACES.split(piece)))
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        strings, size = self.strings, len(self.strings)
        found = [strings[i] for i in np.frombuffer(ids or b"", "<u4").tolist() if i < size]
        return " ".join([s for s in found if s is not None])


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids (binary: little-endian unsigned 32-bit numbers) of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch["__text"]]
            yield pd.DataFrame({"__id": batch["__id"], "n_tokens": [len(i) // 4 for i in ids], "ids": ids})

    rows = docs.select(F.col(id_col).cast("string").alias("__id"), F.col(text_col).alias("__text"))
    return rows.mapInPandas(run, "__id string, n_tokens long, ids binary").select(F.col("__id").cast(docs.schema[id_col].dataType).alias(id_col), "n_tokens", "ids")


def decode(path: str, ids: str = "ids") -> Column:
    """Text of a column of ids, as encode() returns them."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(path)
        for batch in batches:
            yield batch.map(bpe.decode)

    return run(F.col(ids))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = encode(table(spark, sf_dir, "documents"), path)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(decode(path), 256).alias("decoded_sha256"))

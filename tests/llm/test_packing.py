import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from varve.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_first_fit(sizes, capacity):
    room, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for b, r in enumerate(room):
            if r >= sizes[i]:
                break
        else:
            b = len(room)
            room.append(capacity)
        room[b] -= sizes[i]
        out[i] = b
    return out


def test_tree_is_first_fit():
    r = random.Random(3)
    for n in (0, 1, 2, 7, 200):
        sizes = [r.randint(1, 100) for _ in range(n)]
        assert packing.first_fit_decreasing(sizes, 100) == brute_first_fit(sizes, 100)


def test_tokens_equal_the_library():
    lib, ours = Tokenizer.from_file(PATH), packing.Tokens(PATH)
    for t in ["", "a", "Héllo  wörld\n\n x1234!?", "<|endoftext|> b", "é" * 5000, "x" * 3000, " \t\n" * 400, "日本語 テスト 🙂", "\x00\x7f"]:
        assert ours(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def check(rows, texts):
    lib = Tokenizer.from_file(PATH)
    seen, room = {}, {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r)
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in texts.items():
        ids = lib.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(seen[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in room.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    return len(room) * 1024 / sum(r.length for r in rows)


def test_query(spark, sf_small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    assert check(packing.op7_packing(spark, sf_small).collect(), texts) < 1.03


def test_edges_of_input(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "word " * 3000, 5)], "doc_id long, text string, start long")
    assert check(packing.pack(docs, PATH).collect(), {1: None, 2: "", 3: "word " * 3000})
    twice = spark.createDataFrame([(3, "one two"), (3, "one two"), (None, "x")], "doc_id long, text string")
    assert packing.pack(twice, PATH).count() == 3
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_tokenizers_alone_where_the_two_differ():
    import tiktoken

    lib = Tokenizer.from_file(PATH)
    ours = packing.Tokens(PATH)
    assert ours.fast is not None
    ours.fast = tiktoken.Encoding("bytes", pat_str="(?s).", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    for text in ("some words here", "and some more"):
        assert ours(text).tolist() == lib.encode(text, add_special_tokens=False).ids
    assert ours.fast is None
    other = packing.Tokens(public_tokenizers.path("word_bpe_49k.json"))
    assert other.fast is None and other("Some words").tolist() == Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode("Some words", add_special_tokens=False).ids


def test_equal_rows_are_dealt_to_all_groups(spark):
    docs = spark.range(4000).selectExpr("cast(null as bigint) AS doc_id", "'the same few words' AS text")
    rows = packing.pack(docs, PATH, group_docs=500).collect()
    assert len(rows) == 4000 and len({r.sequence_id >> 32 for r in rows}) == 8

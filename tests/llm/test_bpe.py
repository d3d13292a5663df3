import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from varve.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.Bpe(PATH), Tokenizer.from_file(PATH)


def same(ours, lib, text):
    ids = lib.encode(text, add_special_tokens=False).ids
    got = ours.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert ours.decode(got) == lib.decode(ids, skip_special_tokens=False)


def brute_merge(ids, rank, made):
    ids = list(ids)
    while True:
        best = min(((rank[a][b], k) for k, (a, b) in enumerate(zip(ids, ids[1:])) if b in rank[a]), default=None)
        if best is None:
            return ids
        ids[best[1] : best[1] + 2] = [made[best[0]]]


def test_queue_merges_as_brute_force(both):
    merges, r = both[0].merges, random.Random(4)
    for _ in range(400):
        ids = [merges.inner[b] for b in r.choices(b"aeinrst" if r.random() < 0.7 else bytes(range(256)), k=r.randint(1, 40))]
        assert merges.merge(list(ids)) == brute_merge(ids, merges.rank, merges.made)


def test_every_code_point_as_the_library(both):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    # Six thousand at a time, each between letters, digits, marks and spaces.
    for at in range(0, len(points), 6000):
        same(*both, "".join(f"A{c}1{c}!{c} {c}́b\u0345{c}" for c in points[at : at + 6000]))


def test_texts_as_the_library(both):
    r = random.Random(7)
    for text in (
        "", " ", "Hello World's", "I'LL'S'T 'RE", "ΣΑΣ Σας İstanbul ẞ", "<|endoftext|>x<|startoftext|><|ENDOFTEXT|>", "<|endof", "a\x1cb\x1fc \x1d", "é é Å ́x", "日本語 テスト 🙂👍🏽",
        "ab" * 60_000, "é" * 70_000, "x" * 63 + " " + "x" * 64 + " " + "x" * 65, "\x00\x7f\x85\xa0 　", "12345 3.14 ½ Ⅷ",
    ):
        same(*both, text)
    for _ in range(300):
        same(*both, "".join(r.choices("abcXYZ '\n\t.,!-éßñΣς<|>123 ́", k=r.randint(0, 200))))


def test_chunks_forget_and_agree(both, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_CHUNKS", 10)
    ours, r = bpe.Bpe(PATH), random.Random(1)
    for _ in range(50):
        same(ours, both[1], " ".join(r.choices(["one", "two!", "three", "4our", "Fünf", "six's"] + [f"w{k}" for k in range(30)], k=40)))
    assert len(ours.chunks) <= 5 and len(ours.chunks.older) <= 5


def digests(lib, text):
    ids = lib.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query(spark, sf_small, both):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    rows = bpe.op12_bpe(spark, sf_small).collect()
    assert len(rows) == len(texts)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(both[1], texts[r.doc_id]) for r in rows)


def test_edges_of_input(spark, both):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (None, "x y", 7), (None, "x y", 7), (3, "long wörds " * 40_000, 8)], "doc_id long, text string, ids int")
    rows = bpe.encode(docs, PATH)
    got = sorted([(r.doc_id or 0, r.n_tokens, bytes(r.ids)) for r in rows.collect()])
    want = sorted((r.doc_id or 0, digests(both[1], r.text)[0], both[0].encode(r.text)) for r in docs.collect())
    assert got == want and rows.schema["doc_id"].dataType.simpleString() == "bigint"
    text = rows.where("doc_id = 3").select(bpe.decode(PATH).alias("t")).first().t
    assert text == " ".join(["long</w>", "wÃ¶r", "ds</w>"] * 40_000) or text == both[1].decode(both[1].encode("long wörds " * 40_000, add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    assert both[0].decode(np.array([1 << 31, 320], "<u4").tobytes()) == both[1].decode([1 << 31, 320], skip_special_tokens=False)


def test_other_files_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"))

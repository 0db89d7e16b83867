import hashlib
import random

import numpy as np
import pytest

from lodestone.llm.bpe import SegmentTree, codec, decode, decoder, default_path, encode, encoder

ALPHABET = list("abz AZ09'\n\t .,-éßñü—“¿½ªº«_ 　  ́") + ["'s", "'re", "'RE", "  ", " ", " ", "\u0085", "\x1c", "\x1f", "知", "<|endoftext|>", " <|endoftext|> ", "<|endof", "😀", "\r\n", "\x0c", "​", "﻿", "�", "\0", "՘", "₏", "\U00010940", "\U000323b0", "ⅷ", "²", "٣"]


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def ids_of(text):
    return np.frombuffer(encoder(default_path())([text])[0], "<u4").tolist()


def test_segment_tree_against_a_scan():
    rnd = random.Random(1)
    for n in (1, 2, 3, 7, 8, 9, 33):
        values = [rnd.choice([None, *range(5)]) for _ in range(n)]
        tree = SegmentTree(values)
        for _ in range(60):
            held = [(v, i) for i, v in enumerate(values) if v is not None]
            assert tree.least() == (min(held) if held else None)
            i = rnd.randrange(n)
            values[i] = rnd.choice([None, *range(5)])
            tree.put((i, values[i]))


def test_ids_and_texts_equal_the_librarys(exact):
    rnd = random.Random(2)
    back = decoder(default_path())
    for i in range(4000):
        t = ["", " ", "a", " a", "a b", "\n", "<|endoftext|>", "<|endoftext|><|endoftext|>"][i] if i < 8 else "".join(rnd.choices(ALPHABET, k=rnd.randrange(0, 60)))
        want = exact.encode(t, add_special_tokens=False).ids
        assert ids_of(t) == want, repr(t)
        assert back(np.array(want, "<u4").tobytes()) == exact.decode(want, skip_special_tokens=False) == t


def test_trees_together_against_one_tree(monkeypatch):
    from lodestone.llm import bpe

    rnd = random.Random(6)
    own = codec(default_path())
    pieces = list({"".join(rnd.choices("abcdetheiongüß知 ", k=rnd.randrange(1, 22))) for _ in range(3000)} | {"a" * n for n in range(1, 70)})
    got = own.ids(pieces)
    assert all(np.frombuffer(got[p], "<u4").tolist() == own.merge(p.encode()) for p in pieces)
    monkeypatch.setattr(bpe, "KNOWN", 500)
    monkeypatch.setattr(bpe, "AT_ONCE", 300)
    fresh = encoder.__wrapped__(default_path())
    texts = [" ".join(rnd.choices(pieces, k=40)) + "<|endoftext|>" * (i % 3) for i in range(50)]
    assert fresh(texts) == [fresh([t])[0] for t in texts]


def test_every_code_point_in_blocks(exact):
    """Whether the pieces are cut alike, for letters and digits of each version of Unicode."""
    rnd = random.Random(3)
    points = [*range(1, 0x3000), *rnd.sample(range(0x3000, 0xD800), 3000), *rnd.sample(range(0xE000, 0x110000), 6000), *range(0x323B0, 0x323C0), *range(0x18D00, 0x18D30)]
    for a in range(0, len(points), 50):
        t = " ".join(f"a{c}b 1{c}2 .{c}! {c}" for c in map(chr, points[a : a + 50]))
        assert ids_of(t) == exact.encode(t, add_special_tokens=False).ids, hex(points[a])


def test_long_pieces(exact, monkeypatch):
    from lodestone.llm import bpe

    monkeypatch.setattr(bpe, "AT_ONCE", 64)
    rnd = random.Random(4)
    for t in ("a" * 20_000, "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=30_000)), " " * 5000 + "x", "知識" * 3000, "word and <|endoftext|> " * 500):
        assert ids_of(t) == exact.encode(t, add_special_tokens=False).ids
    codec(default_path()).merge(b"ab" * 200_000)  # minutes if a merge took time by the length


def test_broken_bytes_and_ids_out_of_range(exact):
    back = decoder(default_path())
    for ids in ([160], [50256, 160, 50256], [101, 220, 7]):
        assert back(np.array(ids, "<u4").tobytes()) == exact.decode(ids, skip_special_tokens=False)
    assert back(np.array([64, 4_000_000, 65], "<u4").tobytes()) == "ab"


def test_frames(spark, exact):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choices(ALPHABET, k=rnd.choice([0, 5, 900]))), i, "z") for i in range(300)] + [(7, None, None, None), (8, "", 1, None), (None, "same", 2, "y"), (None, "same", 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    got = decode(encode(docs)).collect()
    assert sorted((r["doc_id"] or -1, hashlib.sha256(r["ids"]).hexdigest(), r["decoded"]) for r in got) == sorted(
        (i or -1, hashlib.sha256(np.array(exact.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest(), t or "") for i, t, _, _ in rows
    )
    kept = encode(docs.withColumn("extra", docs.decoded)).columns
    assert kept == ["doc_id", "decoded", "extra", "ids"]
    assert decode(encode(docs.limit(0))).collect() == []
    odd = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    assert decode(encode(odd)).first()["decoded"] == "a�b"


def test_query_against_the_library(spark, exact):
    from lodestone.llm.bpe import op13_bpe

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op13_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = exact.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        back = exact.decode(ids, skip_special_tokens=False)
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())

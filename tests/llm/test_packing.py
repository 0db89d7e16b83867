import random
import zlib

import numpy as np
import pytest

from lodestone.llm.packing import default_path, encoder, knapsack, pack, plan


def test_knapsack_against_enumeration():
    rnd = np.random.default_rng(5)
    for _ in range(30):
        n, room = 6, 14
        v = rnd.random(n) * rnd.integers(0, 2, n)
        best = [0.0] * (room + 1)
        for c in range(1, room + 1):
            best[c] = max([best[c - 1]] + [best[c - s] + v[s - 1] for s in range(1, min(c, n) + 1)])
        got, counts = knapsack(v, room)
        assert got == pytest.approx(best[room]) and (counts * np.arange(1, n + 1)).sum() <= room and counts @ v == pytest.approx(got)


def test_plan_holds_demand_with_little_waste():
    rnd = np.random.default_rng(1)
    demand = rnd.integers(0, 400, 64)
    got = plan(demand, 64)
    assert (sum(p * t for p, t in got) == demand).all()
    assert all((p * np.arange(1, 65)).sum() <= 64 for p, _ in got)
    used, need = sum(t for _, t in got), (demand * np.arange(1, 65)).sum() / 64
    assert used <= need * 1.02 + 64


def whole_ids(text):
    from tokenizers import Tokenizer

    return np.asarray(Tokenizer.from_file(default_path()).encode(text, add_special_tokens=False).ids, dtype="<u4")


def test_ids_of_chunks_equal_those_of_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    from lodestone.llm import packing

    monkeypatch.setattr(packing, "CHUNKS", 50)
    fast, exact = encoder.__wrapped__(default_path()), Tokenizer.from_file(default_path())
    rnd = random.Random(2)
    alphabet = list("abz AZ09'\n\t .,-éßñü—“¿½ªº«_ \u3000\u00a0\u2009\u0301") + ["'s", "  ", " ", " ", "\u0085", "\x1c", "\x1f", "知", "<|endoftext|>", " <|endoftext|> ", "😀", "\r\n", "\x0c", "\u200b", "\ufeff"]
    for i in range(3000):
        t = ["", " ", "a", " a", "a b", "\n"][i] if i < 6 else "".join(rnd.choices(alphabet, k=rnd.randrange(0, 60)))
        assert np.frombuffer(fast(t), "<u4").tolist() == exact.encode(t, add_special_tokens=False).ids, repr(t)


def test_ids_of_many_texts_equal_those_of_each():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from lodestone.llm.packing import batch_encoder

    encode, exact = batch_encoder.__wrapped__(default_path()), Tokenizer.from_file(default_path())
    rnd = random.Random(3)
    words = ["it's", "'tis", "end.\nThe", "'", "x's.", "don't,", "a", "\n", "", "é%%%", "\0", "\1", "a\0b", "\nb", "<|endoftext|>", "1st", "\u3000", "\u00d7a", "[x]='s'", "知.a"]
    for size in (0, 1, 2, 40, 400):
        texts = ["".join(rnd.choice(words) + rnd.choice([" ", " ", "", "\n", "  "]) for _ in range(rnd.randrange(12))) for _ in range(size)]
        got = encode(pa.array(texts, pa.string()))
        assert [g.tolist() for g in got] == [exact.encode(t, add_special_tokens=False).ids for t in texts]


def test_pack_round_trip(spark):
    rnd = random.Random(4)
    words = ["the", "of", "naïve", "9", "\n", "知", "x" * 40]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.choice([0, 3, 40, 900, 3000])))) for i in range(60)] + [(7, None), (8, ""), (9, "same"), (9, "same")]
    got = pack(spark.createDataFrame([(a, b, 1, "z") for a, b in rows], "doc_id long, text string, length int, class string")).collect()
    want = []
    for i, t in rows:
        ids = np.append(whole_ids(t or ""), 1).astype("<u4")
        want += [(i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(by) == list(range(len(by)))


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []

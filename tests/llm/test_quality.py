import random
import zlib

import numpy as np
import pyarrow as pa

from lodestone.llm.hashing import blocks, buffers, shingles, words
from lodestone.llm.quality import Model, features, score


def corpus(n=600):
    rnd = random.Random(8)
    good = ["the", "river", "stone", "winter", "letter", "garden", "quiet", "morning", "paper", "light"]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = rnd.choices(good, k=rnd.randrange(20, 80))
        rows.append((i, " ".join(x + "###" for x in w) if bad and i % 8 else " ".join([w[0]] * 50) if bad else " ".join(w), 0.5))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_words_and_shingles_against_python():
    rnd = random.Random(1)
    texts = ["", " ", "a", "One two\tTHREE", "\x0b é É \xa0x  y\n"] + ["".join(rnd.choices("ab C\né　", k=rnd.randrange(60))) for _ in range(100)]
    import re

    raw, offsets = buffers(pa.array(texts))
    h, t = words(raw, offsets)
    want = [(i, "".join(c.lower() if "A" <= c <= "Z" else c for c in w)) for i, x in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", x)]
    assert [i for i, _ in want] == t.tolist()
    seen = {}
    assert all(seen.setdefault(w, int(x)) == int(x) for (_, w), x in zip(want, h, strict=True)) and len(set(seen.values())) == len(seen)
    for k in (1, 4):
        _, row = shingles(h, t, len(texts), k)
        for i in range(len(texts)):
            w = [x for j, x in want if j == i]
            assert (row == i).sum() == len({tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else ())


def test_blocks_cover_rows():
    offsets = np.array([0, 5, 5, 900, 901, 2000])
    got = list(blocks(offsets, most_rows=2, most_bytes=100))
    assert [a for a, _ in got] == [0, 2, 3, 4] or got[0][0] == 0
    assert got[0][0] == 0 and got[-1][1] == 5 and all(x[1] == y[0] for x, y in zip(got, got[1:], strict=False))


def test_vote_against_brute_force():
    texts = [t for _, t, _ in corpus(120)[0]]
    y = np.array([q for _, q in corpus(120)[1]])
    raw, offsets = buffers(pa.array(texts))
    x = features(raw, offsets)
    m = Model(x[:80], y[:80], np.where(y[:80] == 1, 2.0, 1.0))
    z = m.terms(x) @ m.project
    for i in range(80, 120):
        cos = [float(z[i] @ z[j] / (np.linalg.norm(z[i]) * np.linalg.norm(z[j]))) for j in range(80)]
        near = sorted(range(80), key=lambda j: -cos[j])[:15]
        w = [max(cos[j], 0) ** 16 * (2.0 if y[j] else 1.0) for j in near]
        assert abs(m.score(x[i : i + 1])[0] - sum(a * y[j] for a, j in zip(w, near, strict=True)) / sum(w)) < 1e-3


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    rows += [(9001, None, None), (9002, "", None), (9003, "x", None), (5, rows[5][1], None), (9004, "the garden " * 60_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality double")
    lab = spark.createDataFrame([*labels, (1, 1), (None, 1), (2, None), (77777, 0)], "doc_id long, quality int")
    got = score(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= r["quality_score"] <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["quality_score"] >= 0.3) == (truth[r["doc_id"]] == 1) for r in held]) > 0.97
    assert score(docs.limit(0), lab).collect() == []
    assert {r["quality_score"] for r in score(docs, lab.limit(0)).collect()} == {0.5}

import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import suffixes

from lodestone.llm.suffixes import deep_shallow, remove_repeats


def brute(rows, length):
    seen = {}
    data = [(t or "").encode() for _, t in rows]
    for i, d in enumerate(data):
        for s in range(len(d) - length + 1):
            seen.setdefault(d[s : s + length], []).append((i, s))
    out = []
    mask = [np.zeros(len(d), dtype=bool) for d in data]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                mask[i][s : s + length] = True
    for (doc, _), d, m in zip(rows, data, mask, strict=True):
        spans = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        out.append((doc, len(d), int(m.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~m])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("shallow", [8, 16, 64])
def test_deep_shallow_sorts(shallow):
    rnd = random.Random(shallow)
    for _ in range(40):
        pool = [bytes(rnd.choices(b"ab\0", k=rnd.randrange(0, 90))) for _ in range(6)]
        strings = [(rnd.choice(pool)[: rnd.randrange(91)] + bytes(rnd.choices(b"a\0", k=rnd.randrange(6)))) for _ in range(60)]
        groups = np.array([rnd.randrange(3) for _ in strings])
        order, lcp = deep_shallow(strings, groups, shallow)
        assert [(groups[i], strings[i]) for i in order] == sorted(zip(groups.tolist(), strings, strict=True))
        for a in range(len(strings)):
            if a == 0 or groups[order[a]] != groups[order[a - 1]]:
                assert lcp[a] == -1
            else:
                s, t = strings[order[a - 1]], strings[order[a]]
                want = next((i for i in range(min(len(s), len(t))) if s[i] != t[i]), min(len(s), len(t)))
                assert lcp[a] == want, (s, t)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(80), text(22)
    rows = [(i, text(rnd.randrange(5, 120))) for i in range(30)]
    rows += [(100 + i, text(20) + passage[rnd.randrange(0, 40) :] + text(9)) for i in range(12)]
    rows += [(200 + i, text(30) + line + text(30)) for i in range(25)]
    rows += [(300, rows[3][1]), (301, rows[3][1][:-1]), (302, "x" + rows[4][1]), (303, "a" * 900), (304, "ab" * 400), (305, "a" * 150), (306, None), (307, ""), (308, text(30) * 3)]
    for i in range(12):  # near copies
        w = rows[5][1].split(" ")
        w[rnd.randrange(len(w))] = "zzz"
        rows.append((400 + i, " ".join(w)))
    rows.append(rows[0])
    return rows


@pytest.mark.parametrize("seed,length,gram,many", [(1, 200, 48, 2048), (2, 200, 48, 3), (3, 60, 16, 2), (4, 200, 48, 0)])
def test_against_brute_force(spark, seed, length, gram, many):
    rows = corpus(seed)
    docs = spark.createDataFrame([(a, b, "k", 1) for a, b in rows], "doc_id long, text string, key string, tk int").repartition(5)
    got = remove_repeats(docs, length, gram, many).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, length)


def test_long_and_empty(spark):
    rnd = random.Random(9)
    big = "".join(rnd.choices("abcdefgh ", k=3_000_000))
    docs = spark.createDataFrame([(1, big), (2, big[1_000_000:1_000_500])], "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in remove_repeats(docs).collect()) == [(1, 3_000_000, 500, 1), (2, 500, 500, 1)]
    assert remove_repeats(docs.limit(0)).collect() == []


def test_length_out_of_range(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for length in (suffixes.GRAM - 1, suffixes.GRAM + 256):
        with pytest.raises(ValueError):
            suffixes.remove_repeats(docs, length=length)

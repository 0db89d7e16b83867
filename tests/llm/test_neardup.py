import random
import re

import numpy as np
import pytest

from lodestone.llm import neardup
from lodestone.llm.neardup import dedup, least_matches, near_duplicates

SCHEMA = "doc_id long, text string, component_id string, n long"


def brute(rows, k, bound=80):
    sets = []
    for _, t in rows:
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= bound * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], least[find(i)] == d) for i, (d, _) in enumerate(rows))


def texts(seed, n_groups=25):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(n_groups):
        w = rnd.choices(vocab, k=rnd.randrange(60, 200))
        out.append(" ".join(w))
        for _ in range(rnd.randrange(6)):  # chains: each copy edits the one before
            w = list(w)
            for _ in range(rnd.choice([0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            out.append(" ".join(w))
    return out + [None, "", " \t", "One", "one", "one two", "One  two", "é É", "a b c d e f", "A B c D e f"]


@pytest.mark.parametrize("seed,k,block", [(1, 4, 1000), (2, 5, 1000), (3, 4, 3)])
def test_against_brute_force(spark, monkeypatch, seed, k, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = list(enumerate(texts(seed)))
    random.Random(seed).shuffle(rows)
    rows.append(rows[0])
    got = near_duplicates(spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA), k).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, k)


def test_chain_needs_more_than_stars(spark):
    base = [f"v{i}" for i in range(400)]
    rows = []
    for i in range(40):  # neighbours are linked, ends are not
        rows.append((i, " ".join(base[i * 6 : i * 6 + 150])))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 4)


def test_buckets_of_two_beside_decoys(spark):
    rnd, rows = random.Random(9), []
    for _ in range(60):  # b is a near copy of a; each decoy shares bands with b, too little to be linked, and few with a
        a = [f"u{rnd.randrange(10**9)}" for _ in range(100)]
        b = a[:10] + [f"u{rnd.randrange(10**9)}" for _ in range(5)] + a[15:]
        rows += [" ".join(a), " ".join(b)]
        for at in (30, 50, 70):
            rows.append(" ".join(b[:at] + [f"u{rnd.randrange(10**9)}" for _ in range(15)] + b[at + 15 :]))
    rows = list(enumerate(rows))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 5)


def test_dedup_and_edges(spark):
    long = " ".join(f"z{i % 977} q{i}" for i in range(40_000))
    docs = spark.createDataFrame([(5, long, "a", 1), (3, long + " tail", "b", 2), (3, long + " tail", "b", 2), (9, None, "c", 3), (8, "", "d", 4)], SCHEMA)
    got = dedup(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [3, 8, 9]
    assert near_duplicates(docs.limit(0)).collect() == [] and dedup(docs.limit(0)).collect() == []


def test_posterior_bound_misses_little():
    rng, table = np.random.default_rng(0), least_matches(80)
    m = np.cumsum(rng.random((20000, 130)) < 0.8, axis=1)[:, 9::10]
    assert ((m < table).any(axis=1)).mean() < 1e-3 and table[-1] > 70


def test_rows_without_ids_and_equal_ids(spark):
    base = " ".join(f"w{i}" for i in range(60))
    other, third = base.replace("w", "v"), base.replace("w", "u")
    rows = [(None, base, 1), (7, base + " tail", 1), (9, base + " more", 1), (None, other, 2), (None, other + " x", 2), (4, third, 3), (4, "quite another text of enough words", 3), (4, third, 3), (5, None, 4), (5, None, 4), (None, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert [x for x in got if x[0] in (7, 9)] == [(7, 57, 7, True), (9, 57, 7, False)]
    assert sorted((x[2:] for x in got if x[0] is None), key=str) == sorted([(7, False), (None, True), (None, True), (None, True)], key=str)
    kept = [(r["doc_id"], r["text"]) for r in neardup.dedup(docs).collect()]
    assert sorted(kept, key=str) == sorted([(7, base + " tail"), min([(None, other), (None, other + " x")], key=lambda x: __import__("hashlib").md5(x[1].encode()).digest()), (4, third), (4, rows[6][1]), (5, None), (5, None), (None, "")], key=str)


def test_words_that_meet_in_sums_of_powers(spark):
    """The word of Thue and Morse and its complement have equal polynomial hashes modulo 2**64, for every odd base."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"{word} x y z"), (4, f"{other} x y z"), (5, word.upper())]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_chained_hashes_tell_ranges_apart():
    import numpy as np

    from lodestone.llm.hashing import chained

    raw = np.frombuffer(b"abcabcab\0\0abcabcabcabcabcabcabc" * 3, dtype=np.uint8)
    ranges = [(a, b) for a in range(len(raw)) for b in range(a, len(raw) + 1)]
    got = chained(raw, np.array([a for a, _ in ranges]), np.array([b for _, b in ranges])).tolist()
    by = {}
    for (a, b), h in zip(ranges, got, strict=True):
        by.setdefault(raw[a:b].tobytes(), set()).add(h)
    assert all(len(h) == 1 for h in by.values()) and len({h for hs in by.values() for h in hs}) == len(by)


def test_many_rows_without_ids(spark):
    """Each is met by its own text only: as many as with ids take about as long."""
    import time

    rows = [" ".join(f"w{(i * 7 + j) % 997}" for j in range(30)) for i in range(1500)]
    took = []
    for ids in (True, False):
        docs = spark.createDataFrame([(i if ids else None, t) for i, t in enumerate(rows)], "doc_id long, text string")
        began = time.time()
        assert near_duplicates(docs, 4).count() == 1500
        took.append(time.time() - began)
    assert took[1] < 2 * took[0] + 5

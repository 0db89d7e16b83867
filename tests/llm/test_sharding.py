import random
import zlib

import pytest

from lodestone.llm.sharding import _Room, best_fit, pack, shard

SCHEMA = "doc_id long, text string, shard string, size int"


def test_tree_matches_sorted_list():
    rnd, tree, held = random.Random(3), _Room(), []
    for i in range(3000):
        if held and rnd.random() < 0.45:
            k = held.pop(rnd.randrange(len(held)))
            tree.delete(k)
        else:
            held.append((rnd.randrange(60), i))
            tree.insert(held[-1])
        q = rnd.randrange(60)
        assert tree.tightest(q) == min((k for k in held if k[0] >= q), default=None)


def test_best_fit_takes_the_tightest():
    assert best_fit([6, 5, 4, 3], 2, 10) is not None
    assert best_fit([6, 6, 6], 2, 10) is None
    assert best_fit([7, 6, 3], 2, 10) == [0, 1, 0]


def test_pack_oversize_unit_stands_alone():
    units = {0: 1000} | {i: 7 for i in range(1, 300)}
    got = pack(units, 4)
    sums = [sum(units[u] for u in units if got[u] == b) for b in range(4)]
    assert sums[got[0]] == 1000 and max(sums[:got[0]] + sums[got[0] + 1 :]) - min(sums[:got[0]] + sums[got[0] + 1 :]) <= 14


@pytest.mark.parametrize("n", [0, 40])
def test_rows(spark, n):
    rows = [(i, ["same", "", None, f"t{i}" * i, "é" * i][i % 5], "x", 1) for i in range(n)] + [(3, "again", "x", 1)] * (2 if n else 0)
    got = shard(spark.createDataFrame(rows, SCHEMA), 4).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    texts = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert texts == sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    place = {}
    for r in got:
        assert place.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]


def test_groups_against_brute_force(spark):
    rnd = random.Random(6)
    texts = ["long " * 30_000, "copy " * 40] + ["".join(rnd.choices("abcdef ", k=rnd.randrange(0, 400))) for _ in range(300)]
    rows = [(i, texts[rnd.randrange(len(texts)) if rnd.random() < 0.7 else 1]) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = {}
    for _, t in rows:
        sizes[t] = sizes.get(t, 0) + len(t.encode()) + 1
    for parcels in (65_536, 64):
        got = {r["doc_id"]: r["shard"] for r in shard(docs, 8, parcels).collect()}
        place, filled = {}, [0] * 8
        for i, t in rows:
            assert place.setdefault(t, got[i]) == got[i]
        for t, n in sizes.items():
            filled[place[t]] += n
        # largest first into the least filled shard: no packing of these groups can do much better
        heap = [0] * 8
        for n in sorted(sizes.values(), reverse=True):
            heap[heap.index(min(heap))] += n
        unit = sum(sizes.values()) / parcels
        assert max(filled) <= max(heap) * 1.01 + (0 if parcels > 64 else 3 * unit)

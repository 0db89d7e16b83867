import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import embeddings
from lodestone.llm.embeddings import SLACK, _forest, _join, cuts, near_vectors, rotation

SCHEMA = "vec_id long, embedding array<double>, size string, label int"


def brute(rows, bound=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    link = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]) / np.max(np.abs(rows[i][1])), np.array(rows[j][1]) / np.max(np.abs(rows[j][1]))
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= bound:
                    link[i].add(j)
                    link[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        c = min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(link[i]), c, rows[i][0] == c))
    return sorted(out)


def vectors(dim, n, seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    near = base[rng.integers(0, n, n)] + rng.standard_normal((n, dim)) * rng.uniform(0.05, 0.6, (n, 1))
    chain = np.cumsum(np.vstack([base[:1], rng.standard_normal((20, dim)) * 0.25]), axis=0)
    return np.vstack([base, near, chain, base[:5]]).tolist()


@pytest.mark.parametrize("dim,per,part", [(64, 8192, 2048), (64, 20, 16), (10, 30, 7), (3, 50, 50), (1, 10, 5)])
def test_against_brute_force(spark, monkeypatch, dim, per, part):
    monkeypatch.setattr(embeddings, "PER_PIVOT", per)
    monkeypatch.setattr(embeddings, "PART", part)
    rows = [(i, v) for i, v in enumerate(vectors(dim, 90, dim))]
    nan, inf = float("nan"), float("inf")
    rows += [(900, None), (901, []), (902, [0.0] * dim), (903, [nan] + [1.0] * (dim - 1)), (904, [inf] * dim), (905, [None] + [1.0] * (dim - 1)), (906, [1.0, 2.0] * dim), (907, [1.0, 2.0] * dim), (7, rows[7][1])]
    rows += [(910, [x * 1e200 for x in rows[3][1]])]
    got = near_vectors(spark.createDataFrame([(a, b, "s", 1) for a, b in rows], SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


@pytest.mark.parametrize("parts", [2, 5, 6, 19])
def test_each_pair_of_parts_meets_once_in_turns_of_two_copies(parts):
    rounds = embeddings.turns(parts, 10**7)
    assert all(len(offsets) <= 2 for offsets in rounds)
    pairs = [(min(a, b), max(a, b), a) for offsets in rounds for o in offsets for a in range(parts) for b in [(a + o) % parts]]
    assert sorted(pairs) == sorted((low, high, a) for low in range(parts) for high in range(low, parts) for a in {low, high})


def test_turns_of_two_copies_find_all(spark, monkeypatch):
    for name, value in (("PER_PIVOT", 25), ("PART", 30), ("DEALT", 1), ("TILE", (7, 9)), ("CANDIDATES", 16)):
        monkeypatch.setattr(embeddings, name, value)
    written, settle = [], embeddings.settle
    monkeypatch.setattr(embeddings, "settle", lambda df, name: written.append((name, settle(df, name))) or written[-1][1])
    dealt, deal = [], embeddings._dealt
    monkeypatch.setattr(embeddings, "_dealt", lambda *a: dealt.append(deal(*a).count()) or deal(*a))
    rows = list(enumerate(vectors(16, 60, 8)))
    got = near_vectors(spark.createDataFrame([(a, b, "s", 1) for a, b in rows], SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    assert max(dealt) <= 2 * len(rows) and len([n for n, _ in written if n == "vector-links"]) == len(dealt) > 2


def test_pairs_at_a_block_limit():
    rng, dim, n = np.random.default_rng(4), 64, 200
    q, (a, b) = rotation(dim), cuts(dim)[0]
    limit = 0.2 * (b - a) / dim + SLACK
    rows = []
    for _ in range(n):  # squared distance just under the limit in the first block, small in the others
        x = rng.standard_normal(dim)
        x /= np.linalg.norm(x)
        y = x.copy()
        head, step = x[a:b] / np.linalg.norm(x[a:b]), rng.standard_normal(b - a)
        step -= step @ head * head  # a turn of the block: it keeps the norm
        r2, d2 = x[a:b] @ x[a:b], limit * (1 - 1e-10)
        angle = 2 * np.arcsin(np.sqrt(d2 / r2) / 2)
        y[a:b] = np.sqrt(r2) * (np.cos(angle) * head + np.sin(angle) * step / np.linalg.norm(step))
        rows += [(x @ q.T).tolist(), (y @ q.T).tolist()]
    m, found = len(rows), np.zeros(len(rows), dtype=int)
    for k in range(4):
        same = lambda v, t: pa.array(np.full(m, v), t)
        columns = [same(k, pa.int32()), same(0, pa.int32()), same(0, pa.int32()), same(0, pa.int32()), pa.array(range(m), pa.int64()), same(1, pa.int64()), same(0, pa.int32()), same(True, pa.bool_()), pa.array(rows, pa.list_(pa.float64()))]
        batch = pa.RecordBatch.from_arrays(columns, names=["block", "cell", "low", "high", "cls", "size", "part", "resident", "v"])
        for out in _join(dim, 4, 0.9)(iter([batch])):
            for at, other, links in zip(*(c.to_pylist() for c in out.columns), strict=True):
                found[at] += links if other is None else 0
    x = np.array(rows)
    assert found.tolist() == ((x @ x.T >= 0.9).sum(axis=1) - 1).tolist()


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in near_vectors(spark.createDataFrame([(4, None, None, None)], SCHEMA)).collect()] == [(4, 0, 4, True)]


def test_rotation_and_forest():
    q = rotation(16)
    assert np.allclose(q @ q.T, np.eye(16)) and cuts(10)[-1][1] == 10
    i, j = np.array([0, 1, 4]), np.array([1, 2, 5])
    a, b = _forest(i, j, 7)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(1, 0), (2, 0), (5, 4)]

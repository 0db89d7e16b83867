import hashlib
import math
import random

import numpy as np

from lodestone.llm.codes import MOST, OP12_SQL, compress, digest, nearest, op12_vector_codes

KIND = "vec_id long, embedding array<double>, label int, code string, v int"


def brute(vectors, parts=4, entries=256, rounds=4):
    """(codes, errors, books) of (key, integers) in plain Python."""
    kept = sorted(vectors, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[list(cut(v, p)) for _, v in kept[:entries]] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            by = {}
            for _, v in kept:
                by.setdefault(best(cut(v, p), books[p])[1], []).append(cut(v, p))
            for i, rows in by.items():
                books[p][i] = [math.floor(sum(c) / len(rows)) for c in zip(*rows, strict=True)]
    found = [(k, [best(cut(v, p), books[p]) for p in range(parts)]) for k, v in kept]
    return sorted((k or -1, "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f)) for k, f in found), [np.array(b) for b in books]


def test_nearest_against_all_entries():
    rnd = np.random.default_rng(3)
    for n, k, d, high in ((0, 5, 3, 9), (50, 1, 4, 9), (400, 256, 16, 700), (300, 40, 2, 3), (300, 256, 1, 40), (5, 3, 0, 9), (60, 20, 4, MOST)):
        x, c = rnd.integers(-high, high, (n, d)), rnd.integers(-high, high, (k, d))
        if k > 3 and d:
            c[3] = c[1]
        who, dist = nearest(x, c)
        every = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        assert (who == every.argmin(axis=1)).all() and (dist == every.min(axis=1, initial=1 << 62)).all()


def test_compress_against_brute_force(spark):
    rnd = random.Random(7)
    vectors = [(i, [rnd.choice([-1, 1, 0.5]) * rnd.random() for _ in range(8)]) for i in range(120)]
    vectors += [(5, vectors[5][1]), (7, [0.25] * 8), (None, [0.5] * 8), (200, [0.0] * 8), (201, vectors[9][1])]
    odd = [(300, None), (301, [0.1, None] * 4), (302, [float("nan")] * 8), (303, [float("inf")] * 8)]
    rows = [(k, v, (k or 0) % 3 or None, "x", 1) for k, v in vectors + odd]
    got, books = compress(spark.createDataFrame(rows, KIND), entries=16)
    want, theirs = brute([(k, [math.floor(1024 * x) for x in v]) for k, v in vectors], entries=16)
    assert sorted((r["vec_id"] or -1, r["code"], r["error"]) for r in got.collect()) == want
    assert digest(books) == digest(theirs) == hashlib.sha256(",".join(str(x) for b in theirs for x in b.ravel().tolist()).encode()).hexdigest()


def test_odd_vectors(spark):
    rows = [(1, [1.0] * 4, 1, "", 0), (2, [2.0] * 4, 1, "", 0), (3, [1.0] * 3, None, "", 0), (4, [1e30] * 4, None, "", 0), (5, [], 2, "", 0)]
    got, books = compress(spark.createDataFrame(rows, KIND))
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got.collect()) == [(1, "00000000", 0), (2, "01010101", 0), (3, None, None), (4, None, None), (5, None, None)]
    assert [b.shape for b in books] == [(2, 1)] * 4
    got, books = compress(spark.createDataFrame(rows, KIND).where("vec_id = 3"))
    assert books == [] and got.first()["code"] is None
    got, books = compress(spark.createDataFrame([], KIND))
    assert books == [] and got.collect() == []


def test_query_with_null_labels_and_no_rows(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, [rnd.random() for _ in range(4)], None if i % 3 else 5) for i in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op12_vector_codes(spark, str(tmp_path)).collect()
    assert len(got) == 600
    for held in (lambda i: i % 3, lambda i: not i % 3):
        some = [r for r in got if held(r["vec_id"])]
        assert {r["label_error"] for r in some} == {sum(r["error"] for r in some)}
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert op12_vector_codes(spark, f"{tmp_path}/none").collect() == []


def test_query_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    r = c.execute(OP12_SQL)
    names = [d[0] for d in r.description]
    assert sorted(tuple(x[n] for n in names) for x in op12_vector_codes(spark, sf).collect()) == sorted(r.fetchall())

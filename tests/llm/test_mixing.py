import math

import pytest

from lodestone.llm.mixing import exponent, mix, weigh


def docs(spark, n=900):
    rows = [(i, "w " * (i % 7), "big" if i % 3 == 0 else f"s{i % 11}" if i % 5 else None, 1) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mix_epoch int")


def test_exponent(spark):
    t = {"a": 900, "b": 90, "c": 10}
    s = spark.createDataFrame(list(t.items()), "src string, tokens long")
    assert exponent(s, None, 3.0) == pytest.approx(1 - math.log(3) / math.log(90), abs=1e-9)
    assert exponent(s, None, 1e9) == 0 and exponent(s, None, 1.0) == 1
    a = exponent(s, 0.8, 1.0)
    z = sum(v**a for v in t.values())
    assert -sum(v**a / z * math.log(v**a / z) for v in t.values()) == pytest.approx(0.8, abs=1e-6)


def test_keeps_every_row_and_meets_weights(spark):
    d = docs(spark)
    w = {r["src"]: r for r in weigh(d).collect()}
    assert max(r["repeats"] for r in w.values()) <= 2 + 1e-6 and min(r["repeats"] for r in w.values()) == pytest.approx(1)
    got = mix(d).collect()
    assert {r["doc_id"] for r in got} == set(range(900))
    tokens = {}
    for r in got:
        k = "null" if r["source"] is None else "=" + r["source"]
        tokens[k] = tokens.get(k, 0) + len(r["text"].split()) + 1
    for k, r in w.items():
        want = r["repeats"] * r["tokens"]
        assert want - 8 <= tokens[k] <= want + 1e-6
    assert all(0 <= r["mix_key"] < 1.2 for r in got)  # the last block is cut by tokens, not by rows


def test_budget_cuts(spark):
    got = mix(docs(spark), budget=500)
    n = got.selectExpr("sum(size(regexp_extract_all(text, 'w', 0)) + 1) AS n").first()["n"]
    assert 350 <= n <= 500


def test_edges(spark):
    d = docs(spark)
    assert mix(d.limit(0)).collect() == []
    one = spark.createDataFrame([(1, None, None), (1, None, None), (None, "a b", None)], "doc_id long, text string, source string")
    assert mix(one).count() == 3

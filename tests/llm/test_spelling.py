import random
import re
import zlib
from collections import Counter

import pytest

from lodestone.llm import spelling
from lodestone.llm.spelling import DROP, OP11_SQL, near_pairs, op11_spelling, roots, variants, vocabulary

LOWER = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(docs, drop):
    n = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(LOWER.get(c, c) for c in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if drop and i is not None and h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute(docs, drop):
    n = counted(docs, drop)
    near = {a: [b for b in n if one_edit(a, b)] for a in n}
    best = {a: min(bs, key=lambda b: (-n[b], b)) for a, bs in near.items() if bs}
    form = {a: b for a, b in best.items() if n[b] >= 2 * n[a]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), n[w], len(near[w]), n[form[w]] if w in form else -1) for w in n)


def texts(seed, many, letters="abcdeé"):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices(letters, k=rnd.choice([4, 5, 6, 7, 9, 12]))) for _ in range(25)]
    words += [w[:i] + rnd.choice(["", "x", "ÿ", "É"]) + w[i + 1 :] for w in words for i in range(0, len(w), 2)] + ["Straße", "STRASSE", "ÀÉÎõü", "×÷×÷×", "a" * 300, "a" * 299, "a" * 298 + "b"]
    return [(i, rnd.choice([" ", "1", "—", "\n"]).join(rnd.choices(words, k=rnd.choice([0, 1, 30, 200])))) for i in range(many)]


@pytest.mark.parametrize("together", [2, 32])
def test_variants_against_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(spelling, "TOGETHER", together)  # 2: windows are halved down to one code point
    docs = texts(3, 60) + [(9, None), (10, ""), (None, "nullid nullid nullid nullit nullid"), (11, "twice twice twicf"), (11, "twice twice twicf"), (11, "twice twice twicf")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    for drop in (None, 5):
        got = sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or -1) for r in variants(frame, drop=drop).collect())
        assert got == brute(docs, drop)


def test_a_third_of_all_words_share_a_chunk(spark, monkeypatch):
    """Halving keeps every group small: no candidate pairs beyond the bound a row."""
    monkeypatch.setattr(spelling, "TOGETHER", 8)
    rnd = random.Random(4)
    words = list({"common" + "".join(rnd.choices("abcdefgh", k=5)) for _ in range(700)} | {"".join(rnd.choices("abcdefgh", k=7)) for _ in range(700)})
    frame = spark.createDataFrame([(w, rnd.randrange(3, 50)) for w in words], "word string, n long")
    got = {(r["a"], r["b"]) for r in near_pairs(frame).select("a", "b").collect()}
    less = {}
    for w in words:
        for i in range(len(w)):
            less.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    want = {(a, b) for group in less.values() for a in group for b in group if a != b}
    known = set(words)
    want |= {p for (_, v), group in less.items() if v in known for w in group for p in ((w, v), (v, w))}
    assert got == want


def test_windows_are_halved_again_and_again(spark, monkeypatch):
    """Words that differ in one window of eight letters need three rounds of halving; each reads what the round before it wrote."""
    monkeypatch.setattr(spelling, "TOGETHER", 2)
    words = ["a" * i + x + "a" * (31 - i) for i in range(8) for x in "bcd"]
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = {(r["a"], r["b"]) for r in near_pairs(frame).select("a", "b").collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)} and len(got) == 48


def test_windows_of_very_long_words(spark):
    rows = spark.createDataFrame([("a" * 50_000, 3, 50_000, 0, 49_999, 50_000)], "word string, n long, size int, d int, at int, of int")
    assert [(r["low"], r["high"]) for r in spelling._rows(rows, 0, False).collect()] == [(49_999, 50_000)]


def test_chains_of_forms(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w3"), ("b", "c")]
    got = {r["word"]: r["root"] for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {**{f"w{i}": "w37" for i in range(37)}, "a": "w37", "b": "c"}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants(none).collect() == [] and vocabulary(none).collect() == []


def test_query_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    r = c.execute(OP11_SQL)
    names = [d[0] for d in r.description]
    key = lambda t: tuple("" if x is None else str(x) for x in t)
    got = sorted((tuple(x[n] for n in names) for x in op11_spelling(spark, sf).collect()), key=key)
    assert got == sorted(r.fetchall(), key=key) and len(got) > 100
    docs = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {x[names.index("word")]: x[names.index("n")] for x in got} == counted(docs, DROP)

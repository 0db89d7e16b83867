import itertools
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions import acl as A
from lodestone.functions import text as T


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


def tokens(text):
    out = re.findall(r"[a-z0-9]+", text.lower())
    for run in re.findall(r"[一-鿿]+", text.lower()):
        out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return out


@pytest.mark.parametrize("text", ["知识库", "库", "ABX-300知识库", "über", "", "ｆｕｌｌ 全 a😀b 12", "a\nB c"])
def test_tokens(spark, text):
    assert one(spark, text, T.tokens(F.col("t"))) == tokens(text)
    assert one(spark, None, T.tokens(F.col("t"))) == []


def test_clean_is_idempotent(spark):
    dirty = "﻿ a b​\r\nc \t\r\rd­　\n```\n  x\n```  \n"
    once = one(spark, dirty, T.clean(F.col("t")))
    assert once == "a b\nc\n\nd\n```\n  x\n```" and one(spark, once, T.clean(F.col("t"))) == once


def test_clean_long_runs_of_white_space(spark):
    run = " \t" * 150_000
    assert one(spark, f"{run}a{run}b{run}\nc{run}\n{run}", T.clean(F.col("t"))) == f"a{run}b\nc"
    assert one(spark, run, T.clean(F.col("t"))) == ""


def test_dates_titles_and_numbers(spark):
    assert one(spark, "于2024年3月5日发布", T.iso_date(F.col("t"))) == "2024-03-05"
    assert one(spark, "2023-13", T.iso_date(F.col("t"))) == "2023-01-01"
    assert one(spark, "in 2021, was", T.iso_date(F.col("t"))) == "2021-01-01"
    assert one(spark, "no date", T.iso_date(F.col("t"))) is None
    assert one(spark, "x\n# Head line \ny", T.title(F.col("t"), F.lit("s"))) == "Head line"
    assert one(spark, "| a |\n- b\nplain line", T.title(F.col("t"), F.lit("s"))) == "plain line"
    assert one(spark, "财字〔2024〕7号", T.doc_number(F.col("t"))) == "财字〔2024〕7号"
    assert one(spark, "|a|b|\n|c|d|", T.has_table(F.col("t"))) and not one(spark, "|a|b|\nx", T.has_table(F.col("t")))
    assert one(spark, "抱歉，我在当前知识库中没有找到与这个问题足够相关的信息，…", T.is_refusal(F.col("t")))


def test_coverage_edges(spark):
    assert one(spark, "营收是多少", T.coverage(F.col("t"), F.lit("营业收入"))) == 1.0
    assert one(spark, "的了", T.coverage(F.col("t"), F.lit("x"))) == 1.0
    assert one(spark, "abc", T.coverage(F.col("t"), F.lit(""))) == 0.0
    assert one(spark, "a a b", T.support(F.col("t"), F.lit("a c"))) == pytest.approx(2 / 3)


NOW = datetime(2026, 9, 20, 12)


def allows(s, o):
    """Plain statement of the rules, for the grid below."""
    level = (o["access_level"] or "").strip().lower()
    level = level if level in ("department", "tenant") else "private"
    if level != "private" and not s.unrestricted and o["tenant_id"] not in (s.tenants or ()):
        return "tenant"
    if s.principals & {x for x in o["acl_deny"] or () if x} or o["excluded"]:
        return "deny"
    known = bool(s.principals & {x for x in o["acl_allow"] or () if x}) and (o["acl_expires_at"] is None or o["acl_expires_at"] > NOW)
    levels = [x for x in (o["security_level"], o["parent_security_level"], o["effective_security_level"]) if x is not None]
    if (max(levels) if levels else 3 if s.strict else 1) > s.clearance and not known:
        return "security"
    project = o["visibility_mode"] == "project"
    shared = bool(s.projects & set(o["project_ids"] or ()))
    if project and not shared:
        return "project"
    owner = bool(s.user) and o["owner_id"] == s.user
    if level == "private":
        return "ok" if owner or o["tenant_id"] in s.own_tenants else "source"
    near = level == "tenant" or (level == "department" and (s.tenant_wide or (s.department is not None and o["department_id"] == s.department)))
    return "ok" if owner or near or (project and shared) or known else "source"


def test_gate_grid(spark):
    rows = []
    for i, v in enumerate(itertools.product([None, "private", "department", " TENANT "], ["t1", None], ["u1", "u2"], ["d1", None], [(None, None, None), (2, None, None), (0, 3, None), (1, 1, 0)], [None, ["user:u1", None]], [None, ["user:u1"]], [None, datetime(2026, 1, 1), datetime(2027, 1, 1)], [(None, None), ("project", ["p1"]), ("project", ["p9"])])):
        rows.append((f"o{i}", v[1], v[0], v[3], v[2], *v[4], v[8][0], v[8][1], v[6], v[5], v[7], i % 7 == 0))
    schema = "object_id string, tenant_id string, access_level string, department_id string, owner_id string, security_level int, parent_security_level int, effective_security_level int, visibility_mode string, project_ids array<string>, acl_allow array<string>, acl_deny array<string>, acl_expires_at timestamp, excluded boolean"
    objects = spark.createDataFrame(rows, schema)
    scopes = [
        A.Scope("u1", NOW, frozenset({"t1"}), frozenset(), "d1", False, 1, frozenset({"p1"}), frozenset({"user:u1"})), A.Scope("u2", NOW, None, frozenset({"t1"}), None, True, 2, frozenset(), frozenset({"x"}), unrestricted=True, strict=True),
        A.Scope(None, NOW), A.Scope("u1", NOW, frozenset(), clearance=3, principals=frozenset({"user:u1"})),
    ]
    got = objects.select("*", *[A.gate(s).alias(f"g{i}") for i, s in enumerate(scopes)]).collect()
    for r in got:
        for i, s in enumerate(scopes):
            assert r[f"g{i}"] == allows(s, r.asDict()), (r, s)


def test_nearest_vectors_in_parts_of_the_queries(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from lodestone.operators import retrieval as R

    v = np.random.default_rng(1).integers(-2, 3, (40, 4)).astype(float)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(40)[::-1].copy()), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["vec_id", "v"])
    found = {}
    for cells in (1 << 20, 40 * 3, 1):
        monkeypatch.setattr(R, "MOST_CELLS", cells)
        for kind in ("cosine", "dot", "euclid", "manhattan"):
            out = list(R._best_of_block(v[:7], np.arange(7), 5, kind)([batch]))
            assert len(out) == {1 << 20: 1, 120: 3, 1: 7}[cells]
            rows = [tuple(r.values()) for r in pa.Table.from_batches(out).to_pylist()]
            assert found.setdefault(kind, rows) == rows

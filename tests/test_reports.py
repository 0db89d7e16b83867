"""Reports on cases the synthetic tables lack: nulls, empty tables, long texts, ties, hot keys."""

from datetime import datetime

import pytest

from lodestone.functions import acl as A
from lodestone.operators import reports as P
from pyspark.sql import functions as F

CASE = "id int, before string, after string, facts array<string>, preserved array<string>, forbidden array<string>, masked int, expect_masked int, least double, pagemap_ok boolean"


def windows(text):
    found = [text[i : i + 2000] for i in range(0, len(text), 1800)]
    return len(found), sum(not any(c in w for c in P.NOISE) for w in found)


@pytest.mark.parametrize("text", ["", "a", "a" * 1800, "a" * 1801, "a" * 1799 + "\r", "a" * 1801 + "\r" + "b" * 4000, "😀" * 1900 + "­" + "😀" * 2000, "a" * 2000 + "　", "x\n" * 300_000 + "﻿"])
def test_windows_overlap_by_a_tenth(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(P.clean_windows(F.col("t")).alias("w")).first().w
    assert (r.n, r.clean) == windows(text)


def test_cleaning_report(spark):
    rows = [
        (1, "a fact", "a fact", ["a　fact", None], ["a fact"], ["fact", "\r"], 0, None, None, True), (2, None, None, None, None, None, None, None, None, None),
        (3, "x" * 10, "x" * 8, [], [], ["y"], 0, 0, None, True), (4, "x" * 10, "x" * 7, [], [], [], 0, 0, None, True), (5, "x" * 10, "x" * 7, [], ["z"], [], 1, 1, 0.5, True),
    ]
    got = {r.id: r for r in P.cleaning_report(spark.createDataFrame(rows, CASE)).collect()}
    assert (got[1].facts_kept, got[1].preserved_kept, got[1].leaked, got[1].noise_before, got[1].noise_after, got[1].passed) == (1, 1, True, round(1 / 6, 5), 0.0, False)
    assert (got[2].chars_before, got[2].chunks_after, got[2].retention, got[2].leaked, got[2].passed) == (0, 0, 1.0, False, False)
    assert got[3].passed and not got[4].retention_ok and (got[5].retention_ok, got[5].masking_ok, got[5].preserved_kept) == (True, False, 0)
    assert P.cleaning_report(spark.createDataFrame([], CASE)).collect() == []


def test_page_maps_fail_on_wrong_or_missing_spans(spark):
    whole = spark.createDataFrame([(1, "ab\n\ncd", True), (2, "ab", True), (3, "ab", True), (4, "ab", False)], "doc_id int, text string, intact boolean")
    spans = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 4, 6), (2, 0, 0, 1), (4, 0, 0, 2)], "doc_id int, page int, char_start int, char_end int")
    pages = spark.createDataFrame([(1, 0, "ab  "), (1, 1, "​cd"), (2, 0, "ab"), (3, 0, "ab"), (4, 0, "ab")], "doc_id int, page int, text string")
    assert {r.doc_id: r.pagemap_ok for r in P.page_maps(whole, spans, pages).collect()} == {1: True, 2: False, 3: False, 4: False}


OBJECT = "document_id long, object_id string, tenant_id string, access_level string, department_id string, owner_id string, security_level int, parent_security_level int, effective_security_level int, visibility_mode string, project_ids array<string>, acl_allow array<string>, acl_deny array<string>, acl_expires_at timestamp, excluded boolean"
SCOPE = A.Scope("u", datetime(2026, 1, 1), frozenset({"t"}), principals=frozenset({"user:u"}), clearance=1)


def view(document, level="tenant", tenant="t", deny=None, security=1):
    return (document, f"o{document}", tenant, level, None, None, security, None, None, None, None, None, deny, None, False)


def test_labels_out_of_reach_take_their_query_with_them(spark):
    documents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, None)], "document_id long, filename string")
    views = spark.createDataFrame([view(1), view(2), view(3, security=3), view(5)], OBJECT)
    gold = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (2, "b", 1), (2, "gone", 0), (3, "gone", 0), (4, "c", 0), (4, "c", 0), (5, None, 0)], "query_id int, filename string, chunk_index int")
    got = sorted((r.query_id, str(r.filename), r.status, r.gate, r.reason, r.scored) for r in P.resolve_labels(gold, P.reachable_names(documents, views, SCOPE)).collect())
    assert got == [
        (1, "a", "ok", None, None, True), (1, "b", "unattainable", "security", "clearance_short", True), (2, "b", "unattainable", "security", "clearance_short", False), (2, "gone", "problem", None, None, False),
        (3, "gone", "problem", None, None, True), (4, "c", "unattainable", "tenant", "missing_object_view", False), (4, "c", "unattainable", "tenant", "missing_object_view", False), (5, "None", "problem", None, None, True),
    ]


def test_leaks(spark):
    probes = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "b"), (3, None), (4, "zz")], "probe_id int, filename string")
    found = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (1, 12), (2, 10), (9, 11)], "probe_id int, document_id int")
    documents = spark.createDataFrame([(10, "a"), (11, "b"), (12, "b"), (13, "zz")], "document_id int, filename string")
    got = {r.probe_id: (r.returned, r.leaked_docs, r.ok) for r in P.leaks(probes, found, documents).collect()}
    assert got == {1: (4, "a,b", False), 2: (1, "", True), 3: (0, "", True), 4: (0, "", True)}


def test_owners_of_legacy_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (1, None)], "doc_id int, owner_id int")
    schema = "user_id int, role string, active boolean, created_at int"
    users = spark.createDataFrame([(9, "admin", True, 2), (7, "admin", True, 2), (3, "admin", False, 1), (4, "user", True, 0), (6, "admin", None, 0)], schema)
    assert sorted((r.doc_id, r.owner_id) for r in P.assign_owner(rows, users).collect()) == [(1, 7), (1, 7), (2, 5)]
    assert sorted(str(r.owner_id) for r in P.assign_owner(rows, spark.createDataFrame([], schema)).collect()) == ["5", "None", "None"]


def test_refused_objects(spark):
    rows = spark.createDataFrame([view(1), view(2, deny=["user:u"]), view(3, tenant="x")], OBJECT).withColumn("acl_sync_state", F.when(F.col("document_id") == 2, "").otherwise("stale"))
    rows = rows.withColumn("object_id", F.when(F.col("document_id") == 3, "").otherwise(F.concat("object_id", F.lit("x" * 70))))
    got = sorted((r.action, r.user_id, r.resource_id, r.detail) for r in P.acl_drops(rows, SCOPE, "context").collect())
    assert got == [("acl.drop.context", "u", "3", "stage=context document_id=3 gate=tenant reason=missing_object_view acl_sync_state=stale"), ("acl.drop.context", "u", "o2" + "x" * 62, "stage=context document_id=2 gate=deny reason=acl_deny_hit")]


def test_triage_keeps_the_last_word_on_each_column(spark):
    cases = spark.createDataFrame([(1, "open", None, None), (2, "open", "r", "t"), (3, "open", None, None)], "case_id int, status string, resolution string, tags string")
    updates = [(1, 3, "resolved", None, None), (1, 2, "triaged", "why", "x" * 300), (1, 4, "lost", "no", None), (2, 1, None, None, None), (8, 1, "open", None, None), (3, 5, "wontfix", None, None)] + [(3, 10 + k, "triaged" if k % 2 else None, str(k), None) for k in range(500)]
    out, refused = P.triaged(cases, spark.createDataFrame(updates, "case_id int, seq int, status string, resolution string, tags string"))
    assert sorted(map(tuple, out.collect())) == [(1, "resolved", "why", "x" * 256), (2, "open", "r", "t"), (3, "triaged", "499", None)]
    assert sorted(map(tuple, refused.collect())) == [(1, 4, "unknown_status"), (8, 1, "missing")]

"""Capabilities and requests where the synthetic tables do not reach: nulls, empty tables, one document with most events."""

import pytest

from lodestone.operators import sharing as H

EVENTS = "seq long, kind string, actor long, role string, tenant_id string, department string, document_id long, target string, request_id long"
DOCUMENTS = "document_id long, tenant_id string, owner_id long, access_level string, department_id string"
USER = "user_id long, role string, user_department string, tenants array<string>, own_tenants array<string>"
OWNER, HEAD, KEEPER = (1, "employee", "t", "d"), (2, "dept_manager", "t", "d"), (3, "kb_admin", "t", None)


def event(seq, kind, who, document=1, target=None, request=None):
    return (seq, kind, *who, document, target, request)


def outcomes(spark, events, documents=((1, "t", 1, "private", None),)):
    out = H.decide(spark.createDataFrame(list(events), EVENTS), spark.createDataFrame(list(documents), DOCUMENTS))
    return {r.seq: r.outcome for r in out.collect()}, out


def test_a_request_runs_its_course(spark):
    got, out = outcomes(spark, [
        event(1, "share", OWNER, target="department"), event(2, "share", OWNER, target="department"), event(3, "approve", OWNER, request=1), event(4, "approve", HEAD, request=1),
        event(5, "approve", HEAD, request=1), event(6, "share", OWNER, target="department"), event(7, "share", OWNER, target="tenant"), event(8, "approve", HEAD, request=7),
        event(9, "approve", KEEPER, request=7), event(10, "delete", KEEPER), event(11, "delete", OWNER), event(12, "approve", HEAD, request=11), event(13, "approve", KEEPER, request=11),
        event(14, "share", OWNER, target="tenant"), event(15, "cancel", OWNER, request=7), event(16, "cancel", HEAD, request=7), event(17, "reject", HEAD, request=99), event(18, "reject", HEAD, request=18),
    ])
    assert got == {1: "ok", 2: "pending", 3: "forbidden", 4: "ok", 5: "closed", 6: "already_there", 7: "ok", 8: "forbidden", 9: "ok", 10: "direct", 11: "ok", 12: "forbidden", 13: "ok", 14: "absent", 15: "closed", 16: "forbidden", 17: "missing", 18: "missing"}
    rows = {r.seq: r.level for r in out.collect()}
    assert (rows[3], rows[4], rows[9], rows[13]) == ("private", "department", "tenant", None)
    seen = spark.createDataFrame([(1, 10)], "actor long, seq long")
    made = {r.request_id: (r.status, r.reviewer, r.seen) for r in H.requests(out, seen).collect()}
    assert made == {1: ("approved", 2, True), 7: ("approved", 3, True), 11: ("approved", 3, False)}


def test_refusals(spark):
    strange = (4, "employee", "other", "d")
    lost = (5, "employee", "t", " ")
    got, _ = outcomes(spark, [
        event(1, "share", OWNER, target="private"), event(2, "share", OWNER, target=None), event(3, "share", HEAD, target="department"), event(4, "share", HEAD, target="tenant"), event(5, "share", strange, target="tenant"),
        event(6, "share", OWNER, document=77, target="tenant"), event(7, None, OWNER), event(8, "dance", OWNER), event(9, "delete", OWNER), event(10, "delete", strange), event(11, "share", lost, document=2, target="department"),
        event(12, "approve", KEEPER, document=2, request=11), event(13, "cancel", lost, document=2, request=11), event(14, "share", OWNER, document=None, target="tenant"), event(15, "share", OWNER, document=3, target="department"),
        event(16, "cancel", OWNER, document=1, request=11),
    ], [(1, "t", 1, "private", None), (2, "t", 5, "odd", None), (3, "t", 1, " TENANT", "d"), (None, "t", 1, None, None)])
    assert got == {
        1: "bad_target", 2: "bad_target", 3: "direct", 4: "not_owner", 5: "absent", 6: "absent", 7: "unknown", 8: "unknown", 9: "direct", 10: "absent", 11: "ok",
        12: "no_department", 13: "ok", 14: "absent", 15: "not_upward", 16: "missing",
    }


def test_null_actors_own_and_review_nothing(spark):
    nobody = (None, None, None, None)
    admin = (None, "admin", "t", None)
    got, _ = outcomes(spark, [event(1, "share", nobody, document=1, target="tenant"), event(2, "share", (None, "employee", "t", None), document=2, target="tenant"), event(3, "delete", (None, None, "t", "d"), document=3), event(4, "cancel", nobody, document=3, request=3), event(5, "approve", admin, document=3, request=3)], [(1, "t", 1, None, None), (2, "t", None, None, None), (3, "t", 1, "department", "d")])
    assert got == {1: "absent", 2: "not_owner", 3: "ok", 4: "forbidden", 5: "forbidden"}


def test_one_document_with_most_events_keeps_its_order_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        events = []
        for k in range(0, 600, 3):
            events += [event(k, "share", OWNER, target="tenant"), event(k + 1, "share", OWNER, target="tenant"), event(k + 2, "reject", KEEPER, request=k)]
        events += [event(1000 + k, "share", OWNER, document=k, target="tenant") for k in range(2, 40)]
        got, _ = outcomes(spark, reversed(events), [(k, "t", 1, "private", None) for k in range(1, 40)])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got[k] for k in range(600)] == ["ok", "pending", "ok"] * 200 and all(got[1000 + k] == "ok" for k in range(2, 40))


def test_empty_tables(spark):
    got, out = outcomes(spark, [], [])
    made = H.requests(out, spark.createDataFrame([], "actor long, seq long"))
    assert got == {} and made.collect() == []
    users = spark.createDataFrame([(1, "admin", "t", None)], "actor long, role string, tenant_id string, department string")
    assert [tuple(r) for r in H.badges(made, users).collect()] == [(1, 0, 0, 0)]
    assert H.capabilities(spark.createDataFrame([], f"{USER}, {DOCUMENTS}")).collect() == []


def test_private_documents_are_their_owners_alone(spark):
    rows = [(1, None, None, None, None, 1, "t", 1, None, None), (2, "admin", None, ["t"], ["t"], 1, "t", 1, "strange", None), (None, None, None, None, None, 1, "t", None, "private", None), (2, "admin", None, ["x", None], None, 1, "t", 1, "tenant", None)]
    got = H.capabilities(spark.createDataFrame(rows, f"{USER}, {DOCUMENTS}")).collect()
    assert [(r.can_delete, r.delete_denied, r.can_request_delete) for r in got] == [(True, None, False), (False, "private", False), (False, "absent", False), (False, "absent", False)]


@pytest.mark.parametrize("registry, want", [([("a", True), ("a", True), ("b", False)], [["b"], []]), ([], [["a", "b"], ["a"]]), (None, [[], []])])
def test_test_tenants_go_for_those_who_made_some(spark, registry, want):
    users = spark.createDataFrame([(1, "admin", None, ["a", "b"], ["a"]), (2, "employee", None, ["a"], []), (3, "employee", None, None, None)], USER)
    known = None if registry is None else spark.createDataFrame(registry, "tenant_id string, is_test boolean")
    got = {r.user_id: [r.tenants, r.own_tenants] for r in H.without_test_tenants(users, known).collect()}
    assert got == {1: want, 2: [["a"], []], 3: [None, None]}

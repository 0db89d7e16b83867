"""Queries of capabilities and requests over users, documents and events derived from ids alike in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sharing as H
from .common import load, split_columns

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


#: The role of user @, the tenant and the department; LIST( stands for either engine's list constructor.
_ROLE = "CASE @ % 10 WHEN 0 THEN 'admin' WHEN 1 THEN 'kb_admin' WHEN 2 THEN 'dept_manager' WHEN 3 THEN 'company_admin' WHEN 4 THEN 'manager' WHEN 5 THEN 'viewer' WHEN 6 THEN NULL ELSE 'employee' END"
_POWER = "CASE @ % 10 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 3 THEN 2 WHEN 2 THEN 1 WHEN 4 THEN 1 ELSE 0 END"
_TENANT, _DEPARTMENT = "CASE WHEN @ % 11 = 10 THEN 'default' ELSE concat('t', @ % 2) END", "CASE WHEN @ % 13 <> 12 THEN concat('d', @ % 3) END"
#: Documents: a level, an owner (user ids below 60), a tenant that is mostly the owner's, a department.
DOCUMENTS = {
    "document_id": "doc_id", "owner_id": "CASE WHEN doc_id % 23 <> 0 THEN doc_id % 60 END", "tenant_id": f"CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE {_TENANT.replace('@', '(doc_id % 60)')} END",
    "access_level": "CASE doc_id % 7 WHEN 0 THEN 'department' WHEN 1 THEN ' Tenant ' WHEN 2 THEN NULL ELSE 'private' END", "department_id": "CASE WHEN doc_id % 7 = 0 THEN concat(' d', doc_id % 3) END",
}
_SHOWN = ", ".join(f"{e} AS {c}" for c, e in DOCUMENTS.items())
_PAIRS = f"doc_id AS document_id, @ AS user_id, {_ROLE} AS role, {_DEPARTMENT} AS user_department, CASE WHEN @ % 17 = 16 THEN NULL ELSE LIST({_TENANT}, 'x') END AS tenants, CASE WHEN @ % 10 = 0 THEN LIST('t1', 'default') END AS own_tenants"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").selectExpr("doc_id", "explode(array_distinct(array(doc_id % 60, (doc_id * 7 + 3) % 60, (doc_id * 13 + 20) % 60))) AS u")
    return rows.selectExpr("u", *split_columns(_PAIRS.replace("LIST(", "array(").replace("@", "u")), *[f"{e} AS {c}" for c, e in DOCUMENTS.items() if c != "document_id"])


_CAPABLE = f"""SELECT document_id, user_id, CASE WHEN v = 'private' AND own THEN NULL WHEN NOT inside THEN 'absent' WHEN v = 'private' THEN 'private' WHEN w >= 2 THEN NULL WHEN v = 'tenant' THEN 'company'
WHEN w = 0 THEN 'department' WHEN user_department IS NULL THEN 'no_department' WHEN user_department = trim(department_id) THEN NULL ELSE 'other_department' END AS delete_denied,
delete_denied IS NULL AS can_delete,
delete_denied IS NOT NULL AND v <> 'private' AND inside AND (v = 'tenant' OR w >= 2 OR coalesce(user_department = trim(department_id), false)) AS can_request_delete,
w >= 1 AND v <> 'tenant' AS can_publish_department, w >= 2 AS can_publish_company, own AND w < 1 AND v = 'private' AS can_request_department, own AND w < 2 AND v <> 'tenant' AS can_request_company, w >= 2 AND v <> 'private' AS can_transfer_department
FROM (SELECT *, coalesce(owner_id = user_id, false) AS own, coalesce(list_contains(tenants, CASE WHEN trim(tenant_id) = '' THEN 'default' ELSE trim(tenant_id) END), false) AS inside, CASE WHEN lower(trim(access_level)) IN ('tenant', 'department') THEN lower(trim(access_level)) ELSE 'private' END AS v
FROM (SELECT {_PAIRS.replace('LIST(', 'list_value(').replace('@', 'u')}, {_POWER.replace('@', 'u')} AS w, {', '.join(f'{e} AS {c}' for c, e in DOCUMENTS.items() if c != 'document_id')} FROM (SELECT doc_id, unnest(list_distinct([doc_id % 60, (doc_id * 7 + 3) % 60, (doc_id * 13 + 20) % 60])) AS u FROM documents)))"""


@query(_CAPABLE)
def p24_capabilities(spark, sf):
    """What three users may do with each document, and why they may not delete it."""
    out = H.capabilities(_pairs(spark, sf))
    return out.select("document_id", "user_id", *[c for c in out.columns if c.startswith(("can_", "delete_denied"))])


_LIVE = "list_filter({0}, lambda x: NOT (x LIKE 't%' AND x <> 't0'))"


@query(f"SELECT document_id, user_id, array_to_string(list_sort({_LIVE.format('tenants')}), ',') AS tenants, array_to_string(list_sort({_LIVE.format('own_tenants')}), ',') AS own_tenants FROM (SELECT {_PAIRS.replace('LIST(', 'list_value(').replace('@', 'u')} FROM (SELECT doc_id, unnest(list_distinct([doc_id % 60, (doc_id * 7 + 3) % 60, (doc_id * 13 + 20) % 60])) AS u FROM documents)) WHERE own_tenants IS NOT NULL UNION ALL SELECT document_id, user_id, array_to_string(list_sort(tenants), ','), NULL FROM (SELECT {_PAIRS.replace('LIST(', 'list_value(').replace('@', 'u')} FROM (SELECT doc_id, unnest(list_distinct([doc_id % 60, (doc_id * 7 + 3) % 60, (doc_id * 13 + 20) % 60])) AS u FROM documents)) WHERE own_tenants IS NULL")
def p20_consumed_tenants(spark, sf):
    """P20: tenants whose content users consume, less the test tenants for those who made some; the registry is that of customers."""
    registry = load(spark, sf, "customer").selectExpr("concat('t', c_custkey % 3) AS tenant_id", "c_custkey % 3 <> 0 AS is_test")
    out = H.without_test_tenants(_pairs(spark, sf).drop("tenant_id"), registry)
    return out.select("document_id", "user_id", *[F.array_join(F.array_sort(c), ",").alias(c) for c in ("tenants", "own_tenants")])


#: 24 events to a document that exists as a rule: the kind, who acts (the owner in half of the requests), what is named.
_KIND = "CASE (event_id * 7 + event_id DIV 24) % 11 WHEN 4 THEN 'delete' WHEN 5 THEN 'approve' WHEN 6 THEN 'approve' WHEN 7 THEN 'reject' WHEN 8 THEN 'approve' WHEN 9 THEN 'cancel' WHEN 10 THEN 'seen' ELSE 'share' END"
_EVENT = f"event_id AS seq, event_id DIV 24 AS document_id, {_KIND} AS kind, CASE event_id % 5 WHEN 0 THEN 'department' WHEN 4 THEN 'private' WHEN 1 THEN 'department' ELSE 'tenant' END AS target, event_id - 1 - (event_id * 5) % 7 AS request_id, CASE WHEN event_id % 5 <> 3 AND ({_KIND}) IN ('share', 'cancel') THEN (event_id DIV 24) % 60 ELSE (user_id * 3 + event_id) % 60 END AS actor"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").selectExpr(*split_columns(_EVENT))
    return rows.selectExpr("*", f"{_ROLE.replace('@', 'actor')} AS role", f"{_TENANT.replace('@', 'actor')} AS tenant_id", f"{_DEPARTMENT.replace('@', 'actor')} AS department")


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").selectExpr(*[f"{e} AS {c}" for c, e in DOCUMENTS.items()])
    return H.decide(_events(spark, sf).where("kind <> 'seen'"), docs)


_BASE = f"""WITH RECURSIVE d AS (SELECT {_SHOWN} FROM documents),
ev AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seq) AS n FROM (SELECT *, {_POWER.replace('@', 'actor')} AS w, {_TENANT.replace('@', 'actor')} AS tenant, {_DEPARTMENT.replace('@', 'actor')} AS dept FROM (SELECT {_EVENT.replace('DIV', '//')} FROM events)) WHERE kind <> 'seen'),
d0 AS (SELECT k.document_id, d.document_id IS NOT NULL AS alive, owner_id, CASE WHEN trim(tenant_id) = '' THEN 'default' ELSE trim(tenant_id) END AS home, CASE WHEN lower(trim(access_level)) IN ('tenant', 'department') THEN lower(trim(access_level)) ELSE 'private' END AS v, trim(department_id) AS place FROM (SELECT DISTINCT document_id FROM ev) k LEFT JOIN d USING (document_id)),
st AS (SELECT document_id, 0::BIGINT AS n, alive, owner_id, home, v, place, NULL::BIGINT AS pd, NULL::BIGINT AS pt, NULL::BIGINT AS px, NULL::VARCHAR AS xv, NULL::VARCHAR AS xp, NULL::BIGINT AS seq, NULL::VARCHAR AS outcome, NULL::VARCHAR AS tv, NULL::VARCHAR AS tp FROM d0
UNION ALL SELECT document_id, n, alive AND NOT (done AND kind = 'approve' AND slot = 'x'), owner_id, home, CASE WHEN done AND kind = 'approve' AND slot <> 'x' THEN tv ELSE v END, CASE WHEN done AND kind = 'approve' AND slot <> 'x' THEN tp ELSE place END,
CASE WHEN done AND slot = 'd' THEN CASE WHEN kind = 'share' THEN seq END ELSE pd END, CASE WHEN done AND slot = 't' THEN CASE WHEN kind = 'share' THEN seq END ELSE pt END, CASE WHEN done AND slot = 'x' THEN CASE WHEN kind = 'delete' THEN seq END ELSE px END,
CASE WHEN done AND kind = 'delete' THEN tv ELSE xv END, CASE WHEN done AND kind = 'delete' THEN tp ELSE xp END, seq, outcome, CASE WHEN done THEN tv END, CASE WHEN done THEN tp END
FROM (SELECT *, outcome = 'ok' AS done FROM (SELECT *, CASE
WHEN kind = 'share' AND target = 'private' THEN 'bad_target' WHEN kind = 'share' AND w >= CASE target WHEN 'tenant' THEN 2 ELSE 1 END THEN 'direct'
WHEN kind IN ('share', 'delete') AND NOT alive THEN 'absent' WHEN kind = 'share' AND home <> tenant THEN 'absent' WHEN kind = 'share' AND coalesce(owner_id <> actor, true) THEN 'not_owner'
WHEN kind = 'share' AND target = v THEN 'already_there' WHEN kind = 'share' AND v = 'tenant' THEN 'not_upward'
WHEN kind = 'delete' AND may_delete THEN 'direct' WHEN kind = 'delete' AND (v = 'private' OR home <> tenant OR NOT (v = 'tenant' OR w >= 2 OR coalesce(dept = place, false))) THEN 'absent'
WHEN kind = 'share' AND CASE target WHEN 'tenant' THEN pt ELSE pd END IS NOT NULL THEN 'pending' WHEN kind = 'delete' AND px IS NOT NULL THEN 'pending' WHEN kind IN ('share', 'delete') THEN 'ok'
WHEN slot IS NULL THEN 'not_pending' WHEN kind = 'cancel' THEN CASE WHEN by_ = actor THEN 'ok' ELSE 'forbidden' END
WHEN w = 0 OR by_ = actor OR (w < 3 AND by_tenant <> tenant) OR NOT (w >= 2 OR (tv = 'department' AND coalesce(tp = dept, false))) THEN 'forbidden'
WHEN kind = 'reject' THEN 'ok' WHEN slot = 'x' THEN CASE WHEN alive AND NOT may_delete THEN 'forbidden' ELSE 'ok' END WHEN NOT alive THEN 'absent' WHEN tv = 'department' AND tp IS NULL THEN 'no_department' ELSE 'ok' END AS outcome
FROM (SELECT *, CASE kind WHEN 'share' THEN target WHEN 'delete' THEN v ELSE CASE slot WHEN 'd' THEN 'department' WHEN 't' THEN 'tenant' ELSE xv END END AS tv,
CASE kind WHEN 'share' THEN CASE WHEN target = 'department' THEN dept END WHEN 'delete' THEN CASE WHEN v = 'department' THEN place END ELSE CASE slot WHEN 'd' THEN by_dept WHEN 'x' THEN xp END END AS tp
FROM (SELECT s.document_id, e.n, s.alive, s.owner_id, s.home, s.v, s.place, s.pd, s.pt, s.px, s.xv, s.xp, e.seq, e.kind, e.target, e.actor, e.w, e.tenant, e.dept, q.actor AS by_, q.tenant AS by_tenant, q.dept AS by_dept,
CASE WHEN s.v = 'private' THEN coalesce(s.owner_id = e.actor, false) ELSE coalesce(s.home = e.tenant, false) AND (e.w >= 2 OR (s.v = 'department' AND e.w = 1 AND coalesce(e.dept = s.place, false))) END AS may_delete,
CASE WHEN e.kind = 'share' THEN CASE e.target WHEN 'tenant' THEN 't' ELSE 'd' END WHEN e.kind = 'delete' THEN 'x' WHEN e.request_id = s.pd THEN 'd' WHEN e.request_id = s.pt THEN 't' WHEN e.request_id = s.px THEN 'x' END AS slot
FROM st s JOIN ev e ON e.document_id = s.document_id AND e.n = s.n + 1 LEFT JOIN ev q ON q.seq = e.request_id))))),
rows_ AS (SELECT ev.*, st.outcome AS o, st.tv, st.tp, CASE WHEN st.alive THEN st.v END AS level FROM ev JOIN st USING (document_id, n)),
res AS (SELECT r.document_id, r.seq, r.kind, r.actor, r.tenant, CASE WHEN r.kind IN ('share', 'delete') THEN r.seq ELSE r.request_id END AS request_id, r.tv, r.tp, r.level, CASE WHEN r.o <> 'not_pending' THEN r.o WHEN m.seq IS NULL THEN 'missing'
WHEN r.kind = 'cancel' THEN CASE WHEN m.actor = r.actor THEN 'closed' ELSE 'forbidden' END
WHEN r.w >= 1 AND m.actor <> r.actor AND (r.w >= 3 OR m.tenant = r.tenant) AND (r.w >= 2 OR coalesce(m.tv = 'department' AND m.tp = r.dept, false)) THEN 'closed' ELSE 'forbidden' END AS outcome
FROM rows_ r LEFT JOIN rows_ m ON m.seq = r.request_id AND m.document_id = r.document_id AND m.o = 'ok' AND m.kind IN ('share', 'delete')),
made AS (SELECT m.seq AS request_id, CASE m.kind WHEN 'share' THEN 'publish' ELSE 'delete' END AS intent, m.document_id, m.actor AS requester, m.tenant AS tenant_id, m.tv AS target_level, m.tp AS target_department, CASE c.kind WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'cancel' THEN 'cancelled' ELSE 'pending' END AS status,
CASE WHEN c.kind <> 'cancel' THEN c.actor END AS reviewer, c.seq AS decided_seq, coalesce(c.kind = 'cancel' OR l.seq > c.seq, false) AS seen
FROM res m LEFT JOIN res c ON c.request_id = m.seq AND c.kind IN ('approve', 'reject', 'cancel') AND c.outcome = 'ok' LEFT JOIN (SELECT actor, max(seq) AS seq FROM (SELECT {_EVENT.replace('DIV', '//')} FROM events) WHERE kind = 'seen' GROUP BY actor) l ON l.actor = m.actor WHERE m.outcome = 'ok' AND m.kind IN ('share', 'delete'))"""


@query(f"{_BASE} SELECT seq, document_id, kind, actor, outcome, tv AS target_level, tp AS target_department, level FROM res")
def f3_decisions(spark, sf):
    """each event of share and delete requests, taken in a document's order, with what came of it."""
    return _decided(spark, sf).select("seq", "document_id", "kind", "actor", "outcome", "target_level", "target_department", "level")


@query(f"{_BASE} SELECT * FROM made")
def f3_requests(spark, sf):
    """requests with their verdicts, and whether their requesters have seen them."""
    return H.requests(_decided(spark, sf), _events(spark, sf).where("kind = 'seen'"))


@query(f"""{_BASE} SELECT u.actor, count(*) FILTER (m.status = 'pending' AND m.requester <> u.actor AND (u.w >= 3 OR (m.tenant_id = u.tenant AND (u.w = 2 OR (u.w = 1 AND m.target_level = 'department' AND m.target_department = u.dept))))) AS pending_for_me,
count(*) FILTER (m.status = 'pending' AND m.requester = u.actor) AS my_pending, count(*) FILTER (m.status <> 'pending' AND m.requester = u.actor AND NOT m.seen) AS my_decided_unseen
FROM (SELECT DISTINCT actor, w, tenant, dept FROM ev) u LEFT JOIN made m ON true GROUP BY u.actor""")
def f3_badges(spark, sf):
    """what waits for each user who acts, and which verdicts they have not seen."""
    seen = _events(spark, sf)
    users = seen.where("kind <> 'seen'").select("actor", "role", "tenant_id", "department").distinct()
    return H.badges(H.requests(_decided(spark, sf), seen.where("kind = 'seen'")), users)

"""Who may do what with a document, and requests to share or delete one: decided in order, reviewed, counted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import acl as A

#: Roles by what they may publish, delete and review: nothing (any other role), their department's, their company's, all.
POWERS = {"dept_manager": 1, "manager": 1, "kb_admin": 2, "company_admin": 2, "admin": 3}
#: Levels from the narrowest, and the tenant of documents and users without a valid one.
LEVELS, DEFAULT_TENANT, TENANT = ["private", "department", "tenant"], "default", r"^[A-Za-z0-9][A-Za-z0-9_.\-]{0,63}\z"

_DECISION = "seq long, request_id long, outcome string, target_level string, target_department string, level string"


def power(role: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for kv in POWERS.items() for v in kv])[role], F.lit(0))


def tenant(name: Column) -> Column:
    t = F.trim(F.coalesce(name, F.lit("")))
    return F.when(t.rlike(TENANT), t).otherwise(DEFAULT_TENANT)


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _among(value: Column, values: Column) -> Column:
    return F.coalesce(F.array_contains(F.array_compact(values), value), F.lit(False))


def capabilities(pairs: DataFrame) -> DataFrame:
    """pairs with can_delete, delete_denied (why not, null if it may), can_request_delete, can_publish_department,
    can_publish_company, can_request_department, can_request_company and can_transfer_department.

    pairs: user_id, role, user_department, tenants and own_tenants (arrays: what the user sees, and test tenants the user made) beside
    access_level, owner_id, tenant_id, department_id of a document. Private documents are their owner's alone, whatever the role; the
    others stay within the tenants seen. Nobody publishes or requests downwards, and who may publish to a level need not request it.
    A null user, owner, department or array meets nothing; an unknown level counts as private, an unknown role as an employee.
    """
    level, rights = A.level_name(F.col("access_level")), power(F.col("role"))
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), level)
    owner = F.coalesce(F.col("owner_id") == F.col("user_id"), F.lit(False))
    inside, own = _among(tenant(F.col("tenant_id")), F.col("tenants")), _among(tenant(F.col("tenant_id")), F.col("own_tenants"))
    same = F.coalesce(_filled(F.col("user_department")) == _filled(F.col("department_id")), F.lit(False))
    denied = (
        F.when((level == "private") & owner, None).when(~inside, "absent").when(level == "private", "private").when(rights >= 2, None).when(level == "tenant", "company")
        .when(rights == 0, "department").when(_filled(F.col("user_department")).isNull(), "no_department").when(~same, "other_department")
    )
    seen = F.when(level == "private", owner | own).otherwise(inside & ((level == "tenant") | (rights >= 2) | same))
    out = {
        "can_delete": denied.isNull(), "delete_denied": denied, "can_request_delete": denied.isNotNull() & seen & (rank > 1),
        "can_publish_department": (rights >= 1) & (rank <= 2), "can_publish_company": rights >= 2,
        "can_request_department": owner & (rights < 1) & (rank < 2), "can_request_company": owner & (rights < 2) & (rank < 3), "can_transfer_department": (rights >= 2) & (rank > 1),
    }
    return pairs.withColumns(out)


def without_test_tenants(users: DataFrame, registry: DataFrame | None) -> DataFrame:
    """users with tenants and own_tenants less the test tenants of registry (tenant_id, is_test), for users who have own tenants.

    Such a user is left with no tenant at all where the registry cannot be had (None). Users without own tenants, members of test
    tenants among them, keep theirs. Null tenants stay null, unless the registry is missing.
    """
    owns = F.size(F.coalesce("own_tenants", F.array().cast("array<string>"))) > 0
    none = F.array().cast("array<string>")
    if registry is None:
        return users.withColumns({c: F.when(owns, none).otherwise(F.col(c)) for c in ("tenants", "own_tenants")})
    marked = [c for c in users.columns if c not in ("tenants", "own_tenants")]
    rows = users.withColumn("__u", F.monotonically_increasing_id())
    listed = rows.where(owns).select("__u", F.explode(F.array_distinct(F.concat(F.coalesce("tenants", none), "own_tenants"))).alias("tenant_id"))
    tests = listed.join(registry.where("is_test").select("tenant_id").distinct(), "tenant_id").groupBy("__u").agg(F.collect_set("tenant_id").alias("__tests"))
    less = {c: F.when(F.col("__tests").isNull(), F.col(c)).otherwise(F.array_except(c, "__tests")) for c in ("tenants", "own_tenants")}
    return rows.join(tests, "__u", "left").withColumns(less).select(*marked, "tenants", "own_tenants")


def _decide(state: dict, e) -> tuple:
    """(outcome, target level, target department) of one event, and state after it: level, department, alive, and at most one
    pending request for each of department, tenant and delete."""
    level, department, pending = state["level"], state["department"], state["pending"]
    if e.kind in ("share", "delete"):
        target, place = (e.target, e.department if e.target == "department" else None) if e.kind == "share" else (level, department if level == "department" else None)
        slot = target if e.kind == "share" else "delete"
        if e.early is not None:
            return e.early, None, None
        if not state["alive"]:
            return "absent", None, None
        if e.late is not None:
            return e.late, None, None
        if e.kind == "share" and LEVELS.index(target) <= LEVELS.index(level):
            return ("already_there" if target == level else "not_upward"), None, None
        if e.kind == "delete":
            if _deletes(state, e):
                return "direct", None, None
            if level == "private" or not e.inside or not (level == "tenant" or e.power >= 2 or (e.department is not None and e.department == department)):
                return "absent", None, None
        if slot in pending:
            return "pending", None, None
        pending[slot] = (e.seq, e.actor, e.tenant, target, place)
        return "ok", target, place
    slot = next((s for s, r in pending.items() if r[0] == e.request_id), None)
    if slot is None:
        return "not_pending", None, None
    _, requester, within, target, place = pending[slot]
    if e.kind == "cancel":
        if e.actor is None or requester != e.actor:
            return "forbidden", None, None
    else:
        company = e.power >= 2 or (target == "department" and e.department is not None and e.department == place)
        if e.power == 0 or e.actor is None or requester == e.actor or (e.power < 3 and within != e.tenant) or not company:
            return "forbidden", None, None
        if e.kind == "approve" and slot == "delete":
            if state["alive"] and not _deletes(state, e):
                return "forbidden", None, None
            state["alive"] = False
        elif e.kind == "approve":
            if not state["alive"]:
                return "absent", None, None
            if target == "department" and place is None:
                return "no_department", None, None
            state["level"], state["department"] = target, place
    del pending[slot]
    return "ok", target, place


def _deletes(state: dict, e) -> bool:
    if state["level"] == "private":
        return e.owner
    if not e.inside or state["level"] == "tenant" or e.power >= 2:
        return e.inside and e.power >= 2
    return e.power == 1 and e.department is not None and e.department == state["department"]


def decide(events: DataFrame, documents: DataFrame) -> DataFrame:
    """events with outcome, target_level, target_department and level (the document's, after the event; null if there is none).

    events: seq (unique), kind (share, delete, approve, reject, cancel), actor, role, tenant_id and department of the actor, document_id,
    target (of a share), request_id (seq of the request that is reviewed or cancelled). documents: document_id (unique), tenant_id,
    owner_id, access_level, department_id. Outcomes: ok; bad_target, direct (no request needed), absent, not_owner, already_there,
    not_upward, pending (there is one already); missing, forbidden, closed, no_department; unknown for another kind. Approvals raise the
    level or delete the document, so a document's events are taken in order of seq, in one pass over sorted rows that holds the state
    of one document and three requests, however many events one document has. Null actors own and review nothing.
    """
    d = documents.select(
        F.col("document_id").alias("__d"), tenant(F.col("tenant_id")).alias("__tenant"), F.col("owner_id").alias("__owner"), A.level_name(F.col("access_level")).alias("__level"), _filled(F.col("department_id")).alias("__place")
    )
    rows = events.withColumns({"tenant_id": tenant(F.col("tenant_id")), "department": _filled(F.col("department"))})
    rights, found = power(F.col("role")), F.col("__d").isNotNull()
    owner = F.coalesce(F.col("__owner") == F.col("actor"), F.lit(False))
    inside = F.coalesce(F.col("__tenant") == F.col("tenant_id"), F.lit(False))
    share = F.col("kind") == "share"
    early = F.when(~F.coalesce(F.col("kind").isin("share", "delete", "approve", "reject", "cancel"), F.lit(False)), "unknown").when(
        share & ~F.coalesce(F.col("target").isin(LEVELS[1:]), F.lit(False)), "bad_target"
    ).when(share & (rights >= F.when(F.col("target") == "tenant", 2).otherwise(1)), "direct")
    late = F.when(share & ~inside, "absent").when(share & ~owner, "not_owner")
    given = rows.join(d, F.col("document_id") == F.col("__d"), "left").select(
        "seq", F.when(early == "unknown", "share").otherwise(F.col("kind")).alias("kind"), "actor", F.col("tenant_id").alias("tenant"), "department", "document_id", "target", "request_id",
        rights.alias("power"), owner.alias("owner"), inside.alias("inside"), early.alias("early"), late.alias("late"), found.alias("alive"), "__level", "__place",
    ).withColumnsRenamed({"__level": "level", "__place": "place"})

    def run(batches):
        at, state = None, None
        for pdf in batches:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            made = []
            for e in pdf.itertuples(index=False):
                if state is None or e.document_id != at:
                    at, state = e.document_id, {"level": e.level, "department": e.place, "alive": bool(e.alive), "pending": {}}
                outcome, target, place = _decide(state, e)
                made.append((e.seq, e.seq if e.kind in ("share", "delete") and e.early != "unknown" else e.request_id, outcome, target, place, state["level"] if state["alive"] else None))
            yield pd.DataFrame(made, columns=["seq", "request_id", "outcome", "target_level", "target_department", "level"]).astype({"request_id": "Int64"})

    decided = given.repartition("document_id").sortWithinPartitions("document_id", "seq").mapInPandas(run, _DECISION)
    out = rows.drop("request_id").join(decided, "seq")
    made = out.where("outcome = 'ok' AND kind IN ('share', 'delete')").select(
        F.col("seq").alias("__r"), F.col("document_id").alias("__rd"), F.col("actor").alias("__by"), F.col("tenant_id").alias("__rt"), F.col("target_level").alias("__rl"), F.col("target_department").alias("__rp")
    )
    out = out.join(made, (F.col("outcome") == "not_pending") & (F.col("request_id") == F.col("__r")), "left")
    gone = F.col("__r").isNull() | (F.col("__r") > F.col("seq")) | ~F.col("__rd").eqNullSafe(F.col("document_id"))
    mine = F.coalesce(F.col("__by") == F.col("actor"), F.lit(False))
    settled = F.when(gone, "missing").when(F.when(F.col("kind") == "cancel", mine).otherwise(_reviews()), "closed").otherwise("forbidden")
    return out.withColumn("outcome", F.when(F.col("outcome") == "not_pending", settled).otherwise(F.col("outcome"))).drop("__r", "__rd", "__by", "__rt", "__rl", "__rp")


def _reviews() -> Column:
    """Whether the actor of an event may review the request (__by, __rt, __rl, __rp) that it names."""
    rights = power(F.col("role"))
    same = F.coalesce((F.col("__rl") == "department") & (F.col("__rp") == F.col("department")), F.lit(False))
    return F.coalesce((rights >= 1) & (F.col("__by") != F.col("actor")) & ((rights >= 3) | (F.col("__rt") == F.col("tenant_id"))) & ((rights >= 2) | same), F.lit(False))


def requests(decided: DataFrame, seen: DataFrame) -> DataFrame:
    """A row for each request made: request_id, intent, document_id, requester, tenant_id, target_level, target_department, status
    (pending, approved, rejected, cancelled), reviewer, decided_seq, seen.

    decided: rows of decide. seen: actor, seq of the moments at which users looked at their requests. A verdict is seen once its
    requester has looked after it; a cancelled request is.
    """
    ok = decided.where("outcome = 'ok'")
    made = ok.where("kind IN ('share', 'delete')").select(
        "request_id", F.when(F.col("kind") == "share", "publish").otherwise("delete").alias("intent"), "document_id", F.col("actor").alias("requester"), "tenant_id", "target_level", "target_department"
    )
    status = F.when(F.col("kind") == "approve", "approved").when(F.col("kind") == "reject", "rejected").otherwise("cancelled")
    closed = ok.where("kind IN ('approve', 'reject', 'cancel')").select("request_id", status.alias("status"), F.when(F.col("kind") != "cancel", F.col("actor")).alias("reviewer"), F.col("seq").alias("decided_seq"))
    looked = seen.groupBy(F.col("actor").alias("requester")).agg(F.max("seq").alias("__looked"))
    rows = made.join(closed, "request_id", "left").join(looked, "requester", "left")
    read = F.coalesce((F.col("status") == "cancelled") | (F.col("__looked") > F.col("decided_seq")), F.lit(False))
    return rows.select("request_id", "intent", "document_id", "requester", "tenant_id", "target_level", "target_department", F.coalesce("status", F.lit("pending")).alias("status"), "reviewer", "decided_seq", read.alias("seen"))


def badges(made: DataFrame, users: DataFrame) -> DataFrame:
    """actor, pending_for_me, my_pending, my_decided_unseen of each of users (actor, role, tenant_id, department).

    made: rows of requests. What waits for a reviewer is counted once for each tenant and department and once for each requester, so no
    request meets every reviewer: what is in a reviewer's reach, less the reviewer's own.
    """
    waits = made.where("status = 'pending'").select("requester", F.col("tenant_id").alias("__t"), F.when(F.col("target_level") == "department", F.col("target_department")).alias("__p"))
    n = F.count(F.lit(1))
    cells = waits.groupBy("__t", "__p", "requester").agg(n.alias("n"))
    u = users.select("actor", power(F.col("role")).alias("__w"), tenant(F.col("tenant_id")).alias("tenant_id"), _filled(F.col("department")).alias("department"))
    by_place = cells.where("__p IS NOT NULL").groupBy("__t", "__p").agg(F.sum("n").alias("n_place"))
    # '*' is no tenant's name: the row of all tenants
    by_tenant = cells.withColumn("__t", F.explode(F.array("__t", F.lit("*")))).groupBy("__t").agg(F.sum("n").alias("n_tenant"))
    own = cells.join(u.select(F.col("actor").alias("requester"), "__w", "tenant_id", "department"), "requester").groupBy(F.col("requester").alias("actor")).agg(
        F.sum(F.when(
            (F.col("__w") >= 3) | ((F.col("__t") == F.col("tenant_id")) & ((F.col("__w") == 2) | ((F.col("__w") == 1) & (F.col("__p") == F.col("department"))))), F.col("n")
        ).otherwise(0)).alias("n_own"),
    )
    mine = made.groupBy(F.col("requester").alias("actor")).agg(F.count_if(F.col("status") == "pending").alias("my_pending"), F.count_if((F.col("status") != "pending") & ~F.col("seen")).alias("my_decided_unseen"))
    rows = u.join(by_place, (F.col("tenant_id") == F.col("__t")) & (F.col("department") == F.col("__p")), "left").drop("__t", "__p")
    rows = rows.join(by_tenant, F.when(F.col("__w") >= 3, "*").otherwise(F.col("tenant_id")) == F.col("__t"), "left").drop("__t").join(own, "actor", "left").join(mine, "actor", "left")
    reach = F.when(F.col("__w") >= 2, F.col("n_tenant")).when(F.col("__w") == 1, F.col("n_place"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("actor", (zero(reach) - zero(F.col("n_own"))).alias("pending_for_me"), zero(F.col("my_pending")).alias("my_pending"), zero(F.col("my_decided_unseen")).alias("my_decided_unseen"))

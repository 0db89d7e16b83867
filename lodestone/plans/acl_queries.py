"""Queries of the access-control operators over attributes derived from doc_id alike in both engines."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import acl as A
from ..operators import governance as G
from .common import load

QUERIES: dict = {}
ORACLES: dict = {}
NOW = datetime(2026, 9, 20, 12)

#: Column and expression; LIST( stands for either engine's list constructor.
OBJECTS = {
    "object_id": "CASE WHEN doc_id % 53 <> 0 THEN concat('o', doc_id) END",
    "tenant_id": "CASE WHEN doc_id % 17 <> 0 THEN concat('t', doc_id % 4) END",
    "access_level": "CASE doc_id % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'department' WHEN 2 THEN 'tenant' WHEN 3 THEN ' Tenant ' END",
    "department_id": "CASE WHEN doc_id % 19 <> 0 THEN concat('d', doc_id % 3) END",
    "owner_id": "CASE WHEN doc_id % 23 <> 0 THEN concat('u', doc_id % 7) END",
    "security_level": "CASE WHEN doc_id % 6 <> 5 THEN doc_id % 4 END",
    "parent_security_level": "CASE WHEN doc_id % 9 < 4 THEN doc_id % 3 END",
    "effective_security_level": "CASE WHEN doc_id % 8 < 3 THEN doc_id % 2 END",
    "visibility_mode": "CASE WHEN doc_id % 4 = 1 THEN 'project' WHEN doc_id % 4 = 2 THEN 'tier' END",
    "project_ids": "CASE WHEN doc_id % 4 = 1 THEN LIST(concat('p', doc_id % 3)) END",
    "acl_allow": "CASE WHEN doc_id % 10 = 3 THEN LIST('user:u1', NULL) WHEN doc_id % 10 = 4 THEN LIST('role:x') END",
    "acl_deny": "CASE WHEN doc_id % 31 = 0 THEN LIST('dept:d1') WHEN doc_id % 29 = 0 THEN LIST('user:u9', NULL) END",
    "acl_expires_at": "CASE doc_id % 3 WHEN 1 THEN TIMESTAMP '2026-09-01 00:00:00' WHEN 2 THEN TIMESTAMP '2026-12-01 00:00:00' END",
    "excluded": "CASE WHEN doc_id % 37 = 0 THEN true WHEN doc_id % 41 <> 0 THEN false END",
}
OBJECTS_SQL = "SELECT doc_id, " + ", ".join(f"{e.replace('LIST(', 'list_value(')} AS {c}" for c, e in OBJECTS.items()) + " FROM documents"

SCOPES = {
    "member": A.Scope("u1", NOW, frozenset({"t1", "t2"}), frozenset({"t3"}), "d1", False, 1, frozenset({"p1"}), frozenset({"user:u1", "dept:d1"})),
    "wide": A.Scope("u2", NOW, None, frozenset(), None, True, 2, frozenset({"p0", "p2"}), frozenset({"role:x"}), unrestricted=True, strict=True),
    "outsider": A.Scope("u3", NOW, None, frozenset(), "d2", False, 3, frozenset(), frozenset()),
}


def with_objects(docs: DataFrame) -> DataFrame:
    """docs with the columns of OBJECTS."""
    return docs.selectExpr("*", *[f"{e.replace('LIST(', 'array(')} AS {c}" for c, e in OBJECTS.items()])


def objects(spark: SparkSession, sf: str) -> DataFrame:
    return with_objects(load(spark, sf, "documents").select("doc_id"))


def _list(values) -> str:
    return "list_value(" + ", ".join(f"'{v}'" for v in sorted(values)) + ")" if values else "CAST([] AS VARCHAR[])"


def _has(column: str, values) -> str:
    return f"coalesce(list_has_any(list_filter({column}, lambda x: x IS NOT NULL), {_list(values)}), false)" if values else "false"


def _is(column: str, values) -> str:
    return f"coalesce({column} IN ({', '.join(repr(v) for v in sorted(values))}), false)" if values else "false"


def gate_sql(s: A.Scope) -> str:
    lvl = "CASE WHEN lower(trim(coalesce(access_level, ''))) IN ('department', 'tenant') THEN lower(trim(access_level)) ELSE 'private' END"
    ntk = f"({_has('acl_allow', s.principals)} AND (acl_expires_at IS NULL OR acl_expires_at > TIMESTAMP '{s.now}'))"
    tenant = f"(({lvl}) = 'private' OR {str(s.unrestricted).lower()} OR {_is('tenant_id', s.tenants)})"
    eff = f"coalesce(greatest(effective_security_level, security_level, parent_security_level), {3 if s.strict else 1})"
    project = f"(coalesce(visibility_mode = 'project', false) AND {_has('project_ids', s.projects)})"
    dept = "true" if s.tenant_wide else f"coalesce(department_id = '{s.department}', false)" if s.department else "false"
    source = f"(coalesce(owner_id = '{s.user}', false) OR CASE ({lvl}) WHEN 'private' THEN {_is('tenant_id', s.own_tenants)} WHEN 'tenant' THEN true ELSE {dept} OR {project} OR {ntk} END)"
    return f"""CASE WHEN object_id IS NULL OR NOT {tenant} THEN 'tenant' WHEN {_has('acl_deny', s.principals)} OR coalesce(excluded, false) THEN 'deny'
      WHEN {eff} > {s.clearance} AND NOT {ntk} THEN 'security' WHEN coalesce(visibility_mode = 'project', false) AND NOT {_has('project_ids', s.projects)} THEN 'project'
      WHEN NOT {source} THEN 'source' ELSE 'ok' END"""


def reason_sql(s: A.Scope) -> str:
    return f"""CASE WHEN object_id IS NULL THEN 'missing_object_view' ELSE CASE gate WHEN 'tenant' THEN 'tenant_mismatch' WHEN 'deny' THEN CASE WHEN {_has('acl_deny', s.principals)} THEN 'acl_deny_hit' ELSE 'object_excluded' END
      WHEN 'security' THEN 'clearance_short' WHEN 'project' THEN 'project_miss' WHEN 'source' THEN 'no_source_hit' ELSE 'ok' END END"""


def _register(name: str, f, sql: str, doc: str) -> None:
    f.__name__, f.__doc__ = name, doc
    QUERIES[name], ORACLES[name] = f, sql


for _name, _scope in SCOPES.items():
    _register(
        f"p4_allows_{_name}",
        lambda spark, sf, s=_scope: objects(spark, sf).select("doc_id", A.gate(s).alias("gate"), A.reason(s).alias("reason"), A.allows(s).alias("allowed")),
        f"WITH o AS ({OBJECTS_SQL}), g AS (SELECT *, {gate_sql(_scope)} AS gate FROM o) SELECT doc_id, gate, {reason_sql(_scope)} AS reason, gate = 'ok' AS allowed FROM g",
        f"P4 to P10: the {_name} scope's decision, gate and reason for every object.",
    )
    _lvl = "CASE WHEN lower(trim(coalesce(access_level, ''))) IN ('department', 'tenant') THEN lower(trim(access_level)) ELSE 'private' END"
    _own, _dept = f"coalesce(owner_id = '{_scope.user}', false)", "true" if _scope.tenant_wide else f"coalesce(department_id = '{_scope.department}', false)" if _scope.department else "false"
    _tc = "true" if _scope.tenants is None and _scope.unrestricted else _is("tenant_id", _scope.tenants)
    _acl = f"(({_lvl}) = 'tenant' OR (({_lvl}) = 'department' AND {_dept}) OR (({_lvl}) = 'private' AND ({_own} OR {_is('tenant_id', _scope.own_tenants)})))"
    _register(
        f"p3_document_scope_{_name}",
        lambda spark, sf, s=_scope: objects(spark, sf).select("doc_id", A.tenant_clause(s).alias("in_tenant"), A.document_acl(s).alias("in_acl"), A.document_scope(s).alias("visible")),
        f"WITH o AS ({OBJECTS_SQL}) SELECT doc_id, {_tc} AS in_tenant, {_acl} AS in_acl, ({_tc} AND {_acl}) OR (({_lvl}) = 'private' AND {_own}) AS visible FROM o",
        f"P1 to P3: documents of the {_name} scope.",
    )

_S = SCOPES["member"]


def p22_filter_status(spark, sf):
    """Chunk rows left after the object check, and clean, partial or all_dropped a document."""
    rows = objects(spark, sf).withColumn("parent", F.col("doc_id") % 20)
    return G.filter_status(rows, _S, "parent")


_register("p22_filter_status", p22_filter_status, f"WITH o AS ({OBJECTS_SQL}), g AS (SELECT doc_id % 20 AS parent, {gate_sql(_S)} AS gate FROM o) SELECT parent, count(*) AS n, count(*) FILTER (gate = 'ok') AS kept, CASE WHEN count(*) FILTER (gate = 'ok') = count(*) THEN 'clean' WHEN count(*) FILTER (gate = 'ok') = 0 THEN 'all_dropped' ELSE 'partial' END AS status FROM g GROUP BY 1", p22_filter_status.__doc__)


def g3_documents_per_tenant(spark, sf):
    """Visible documents and those without an effective level by tenant."""
    rows = objects(spark, sf)
    none = F.col("effective_security_level").isNull() & F.col("security_level").isNull() & F.col("parent_security_level").isNull()
    return rows.groupBy("tenant_id").agg(F.count_if(A.allows(_S)).alias("visible"), F.count_if(none).alias("no_level"), F.count(F.lit(1)).alias("n"))


_register("g3_documents_per_tenant", g3_documents_per_tenant, f"WITH o AS ({OBJECTS_SQL}), g AS (SELECT *, {gate_sql(_S)} AS gate FROM o) SELECT tenant_id, count(*) FILTER (gate = 'ok') AS visible, count(*) FILTER (effective_security_level IS NULL AND security_level IS NULL AND parent_security_level IS NULL) AS no_level, count(*) AS n FROM g GROUP BY tenant_id", g3_documents_per_tenant.__doc__)


def d6_derive_children(spark, sf):
    """A child's level is the greatest of its own and its source's, exclusion and denials add up, allowances end."""
    rows = objects(spark, sf)
    return G.derive_children(rows.where("doc_id % 10 <> 0"), rows.where("doc_id % 10 = 0"))


_register("d6_derive_children", d6_derive_children, f"""WITH o AS ({OBJECTS_SQL}), p AS (SELECT * FROM o WHERE doc_id % 10 = 0), c AS (SELECT * FROM o WHERE doc_id % 10 <> 0)
SELECT c.doc_id, greatest(c.security_level, c.effective_security_level, p.effective_security_level, p.security_level) AS effective_security_level, coalesce(c.excluded, false) OR coalesce(p.excluded, false) AS excluded,
array_to_string(list_sort(list_distinct(list_concat(list_filter(coalesce(c.acl_deny, []), lambda x: x IS NOT NULL), list_filter(coalesce(p.acl_deny, []), lambda x: x IS NOT NULL)))), ',') AS acl_deny, 0 AS n_allow
FROM c LEFT JOIN p ON p.doc_id = c.doc_id - c.doc_id % 10""", d6_derive_children.__doc__)

GRANTS = "SELECT concat('o', doc_id % 40) AS object_id, concat('user:u', doc_id % 9) AS subject, CASE WHEN doc_id % 6 = 5 THEN 'deny' ELSE 'allow' END AS effect, CASE doc_id % 4 WHEN 3 THEN 'pending' ELSE 'approved' END AS status, CASE doc_id % 5 WHEN 0 THEN CAST(NULL AS TIMESTAMP) WHEN 1 THEN TIMESTAMP '2026-09-01 00:00:00' WHEN 2 THEN TIMESTAMP '2026-10-01 00:00:00' ELSE TIMESTAMP '2026-11-01 00:00:00' END AS expires_at FROM documents"


def d7_object_acl(spark, sf):
    """Allow lists of active approved grants, and when the earliest of them ends (never, if one never ends)."""
    load(spark, sf, "documents").createOrReplaceTempView("__grants_of")
    return G.object_acl(spark.sql(GRANTS.replace("FROM documents", "FROM __grants_of")), NOW)


_register("d7_object_acl", d7_object_acl, f"SELECT object_id, array_to_string(list_sort(list_distinct(list(subject))), ',') AS acl_allow, CASE WHEN count(*) FILTER (expires_at IS NULL) = 0 THEN min(expires_at) END AS acl_expires_at, count(*) AS n_grants FROM ({GRANTS}) WHERE effect = 'allow' AND status = 'approved' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}') GROUP BY object_id", d7_object_acl.__doc__)


def q1_stale_objects(spark, sf):
    """Objects whose level or department is distinct from their document's (department kept only at department level)."""
    rows = objects(spark, sf)
    docs = rows.select((F.col("doc_id")).alias("document_id"), A.level_name(F.col("access_level")).alias("access_level"), "department_id")
    objs = rows.select("doc_id", ((F.col("doc_id") * 7) % 500).alias("document_id"), A.level_name(F.col("access_level")).alias("access_level"), "department_id")
    return G.stale_objects(objs, docs)


_L = "CASE WHEN lower(trim(coalesce(access_level, ''))) IN ('department', 'tenant') THEN lower(trim(access_level)) ELSE 'private' END"
_register("q1_stale_objects", q1_stale_objects, f"WITH o AS ({OBJECTS_SQL}), d AS (SELECT doc_id AS document_id, {_L} AS dl, department_id AS dd FROM o), s AS (SELECT doc_id, (doc_id * 7) % 500 AS document_id, {_L} AS ol, department_id AS od FROM o) SELECT doc_id, document_id, dl AS access_level, CASE WHEN dl = 'department' THEN dd END AS department_id FROM s JOIN d USING (document_id) WHERE ol IS DISTINCT FROM dl OR od IS DISTINCT FROM (CASE WHEN dl = 'department' THEN dd END)", q1_stale_objects.__doc__)


def q3_drift(spark, sf):
    """Q3: fields in which a second store's payload differs (lists in any order), and payloads that are missing."""
    rows = objects(spark, sf)
    payload = rows.where("doc_id % 15 <> 0").withColumn("security_level", F.when(F.col("doc_id") % 12 == 0, 9).otherwise(F.col("security_level"))).withColumn("acl_deny", F.when(F.col("doc_id") % 62 != 0, F.reverse("acl_deny")))
    return G.payload_drift(rows, payload, "doc_id", ["tenant_id", "access_level", "department_id", "security_level", "visibility_mode", "project_ids", "acl_allow", "acl_deny"])


_register("q3_drift", q3_drift, f"""WITH o AS ({OBJECTS_SQL}), p AS (SELECT doc_id, CASE WHEN doc_id % 12 = 0 THEN 9 ELSE security_level END AS sl, CASE WHEN doc_id % 62 <> 0 THEN acl_deny END AS ad FROM o WHERE doc_id % 15 <> 0),
j AS (SELECT o.doc_id, p.doc_id IS NULL AS missing, o.security_level IS DISTINCT FROM sl AS a, list_sort(o.acl_deny) IS DISTINCT FROM list_sort(ad) AS b FROM o LEFT JOIN p USING (doc_id))
SELECT 'missing' AS field, count(*) FILTER (missing) AS n FROM j UNION ALL SELECT 'security_level', count(*) FILTER (NOT missing AND a) FROM j UNION ALL SELECT 'acl_deny', count(*) FILTER (NOT missing AND b) FROM j
UNION ALL SELECT unnest(['tenant_id', 'access_level', 'department_id', 'visibility_mode', 'project_ids', 'acl_allow']), 0""", q3_drift.__doc__)


def q4_coverage(spark, sf):
    """Q4: share of objects with each payload key, by bucket."""
    rows = objects(spark, sf).withColumn("bucket", F.concat(F.lit("b"), F.col("doc_id") % 3))
    return G.key_coverage(rows, "bucket", ["tenant_id", "access_level", "department_id", "acl_allow"])


_register("q4_coverage", q4_coverage, f"WITH o AS ({OBJECTS_SQL}) SELECT concat('b', doc_id % 3) AS bucket, count(*) AS n, " + ", ".join(f"round(count({c})::DOUBLE / count(*), 6) AS {c}" for c in ("tenant_id", "access_level", "department_id", "acl_allow")) + " FROM o GROUP BY 1", q4_coverage.__doc__)


def q5_view_keys(spark, sf):
    """Q5, Q6: lookup keys of object views by kind, and whether their document is materialised."""
    rows = objects(spark, sf).selectExpr("object_id", "doc_id % 30 AS document_id", "CASE doc_id % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'image' WHEN 2 THEN 'parent' ELSE 'chunk' END AS object_type", "doc_id AS chunk_index")
    return G.view_keys(rows)


_register("q5_view_keys", q5_view_keys, f"WITH o AS ({OBJECTS_SQL}), r AS (SELECT object_id, doc_id % 30 AS document_id, doc_id % 4 AS t, doc_id FROM o WHERE object_id IS NOT NULL) SELECT document_id, CASE t WHEN 0 THEN 'doc' WHEN 1 THEN 'img:' || object_id WHEN 2 THEN 'pc:' || object_id ELSE 'ci:' || doc_id END AS view_key, object_id, bool_or(t = 3) OVER (PARTITION BY document_id) AS materialized FROM r", q5_view_keys.__doc__)


_DOCS = {
    "document_id": "concat('d', doc_id)", "tenant_id": "CASE WHEN doc_id % 17 <> 0 THEN concat('t', doc_id % 4) END", "owner_id": "concat('u', doc_id % 7)", "department_id": "CASE WHEN doc_id % 19 <> 0 THEN concat('d', doc_id % 3) END",
    "access_level": "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'department' ELSE 'tenant' END", "visibility_mode": "CASE WHEN doc_id % 4 = 1 THEN 'project' END", "security_level": "CASE WHEN doc_id % 6 <> 5 THEN cast(doc_id % 4 AS int) END",
    "project_ids": "LIST(concat('p', doc_id % 3))", "acl_allow": "CASE WHEN doc_id % 10 = 3 THEN LIST('user:u1') END", "acl_deny": "CASE WHEN doc_id % 3 = 0 THEN LIST('user:u9', 'dept:d1') END",
}
_POINTS = {
    "document_id": "concat('d', doc_id)", "at": "p", "point_id": "concat('x', p)", "content_type": "CASE (doc_id + p) % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'image' WHEN 3 THEN ' Code' END",
    "image_id": "CASE WHEN (doc_id + p) % 3 < 2 THEN concat('i', (doc_id + p) % 2) END", "image_path": "concat('images/', p, '.png')", "chunk_index": "CASE WHEN p < 7 THEN p // 2 END", "page_number": "p + 1",
}
_UPPERS = {"document_id": "concat('d', doc_id)", "at": "p", "parent_id": "CASE WHEN p < 4 THEN concat('pc', p // 2) END", "owner_id": "CASE WHEN p = 0 THEN 'u99' END", "department_id": "cast(NULL AS varchar)", "access_level": "CASE WHEN p = 2 THEN 'private' END", "tenant_id": "cast(NULL AS varchar)"}


def _columns(of: dict, duck: bool):
    """The expressions for either engine: SQL for DuckDB, a list for Spark."""
    said = [f"{e} AS {c}" for c, e in of.items()]
    return ", ".join(said).replace("LIST(", "list_value(") if duck else [e.replace("LIST(", "array(").replace("//", "div").replace("varchar", "string") for e in said]


_CASCADE_SQL = f"""WITH RECURSIVE b AS (SELECT document_id, coalesce(tenant_id, 'default') AS tenant_id, owner_id, department_id, coalesce(access_level, 'private') AS access_level, coalesce(security_level, {A.DEFAULT_LEVEL}) AS lv, coalesce(acl_allow, []) AS aa, coalesce(acl_deny, []) AS ad FROM (SELECT {_columns(_DOCS, True)} FROM documents)),
p AS (SELECT *, coalesce(trim(content_type), 'text') AS ct FROM (SELECT {_columns(_POINTS, True)} FROM documents, range(8) AS r(p))),
n AS (SELECT document_id, document_id AS object_id, 'doc' AS object_type, CAST(NULL AS VARCHAR) AS up, CAST(NULL AS INT) AS chunk_index, CAST(NULL AS INT) AS page_number, CAST(NULL AS VARCHAR) AS image_path, CAST(NULL AS VARCHAR) AS o, CAST(NULL AS VARCHAR) AS al, false AS bare FROM b
  UNION ALL SELECT document_id, document_id || '::' || image_id, 'image', document_id, NULL, page_number, image_path, NULL, NULL, false FROM p WHERE image_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, image_id ORDER BY at) = 1
  UNION ALL SELECT document_id, document_id || '::' || point_id, CASE lower(ct) WHEN 'table' THEN 'table' WHEN 'code' THEN 'code' WHEN 'image' THEN 'image' ELSE 'text_chunk' END, CASE WHEN image_id IS NULL THEN document_id ELSE document_id || '::' || image_id END, CASE WHEN row_number() OVER (PARTITION BY document_id, chunk_index ORDER BY at) = 1 THEN chunk_index END, page_number, image_path, NULL, NULL, image_id IS NOT NULL FROM p WHERE NOT (ct = 'image' AND image_id IS NOT NULL)
  UNION ALL SELECT document_id, document_id || '::' || parent_id, 'parent_chunk', document_id, NULL, NULL, NULL, owner_id, access_level, true FROM (SELECT {_columns(_UPPERS, True)} FROM documents, range(5) AS r(p)) WHERE parent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, parent_id ORDER BY at) = 1),
w AS (SELECT object_id, document_id, CAST(NULL AS INT) AS parent_level, lv AS level FROM n JOIN b USING (document_id) WHERE up IS NULL UNION ALL SELECT n.object_id, n.document_id, w.level, greatest(b.lv, w.level) FROM w JOIN n ON n.up = w.object_id AND n.document_id = w.document_id JOIN b ON b.document_id = n.document_id)
SELECT n.object_id, n.object_type, n.up AS parent_object_id, w.parent_level, w.level, b.tenant_id, coalesce(n.o, b.owner_id) AS owner_id, coalesce(n.al, b.access_level) AS access_level, CASE WHEN n.bare THEN '' ELSE array_to_string(b.aa, ',') END AS allow,
  array_to_string(CASE WHEN n.bare AND n.object_type <> 'parent_chunk' THEN list_sort(b.ad) ELSE b.ad END, ',') AS deny, n.chunk_index, n.page_number, n.image_path FROM n JOIN w USING (document_id, object_id) JOIN b USING (document_id)"""


def d5_cascade(spark, sf):
    """Object rows of every document, its images, chunks and parent chunks, each as strict as what it comes from."""
    docs = load(spark, sf, "documents").select("doc_id")
    many = lambda n: docs.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = G.cascade(docs.selectExpr(*_columns(_DOCS, False)), many(8).selectExpr(*_columns(_POINTS, False)), many(5).selectExpr(*_columns(_UPPERS, False)))
    return out.select(
        "object_id", "object_type", "parent_object_id", F.col("parent_security_level").alias("parent_level"), F.col("effective_security_level").alias("level"), "tenant_id", "owner_id", "access_level",
        F.array_join("acl_allow", ",").alias("allow"), F.array_join("acl_deny", ",").alias("deny"), "chunk_index", "page_number", "image_path",
    )


QUERIES["d5_cascade"], ORACLES["d5_cascade"] = d5_cascade, re.sub(r"\bat\b", '"at"', _CASCADE_SQL)

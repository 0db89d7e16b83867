"""Access control: one scope, compiled to Columns over object rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT_LEVEL, DEFAULT_LEVEL, TOP_LEVEL = 3, 1, 3


@dataclass(frozen=True)
class Scope:
    """Who asks. tenants None or empty: no tenant at all unless `unrestricted`."""

    user: str | None
    now: datetime
    tenants: frozenset[str] | None = None
    own_tenants: frozenset[str] = field(default_factory=frozenset)
    department: str | None = None
    tenant_wide: bool = False
    clearance: int = 0
    projects: frozenset[str] = field(default_factory=frozenset)
    principals: frozenset[str] = field(default_factory=frozenset)
    unrestricted: bool = False
    strict: bool = False


def _in(column: Column, values) -> Column:
    return F.coalesce(column.isin(sorted(values)), F.lit(False)) if values else F.lit(False)


def _meets(column: Column, values) -> Column:
    """Whether an array column holds any of the values; null elements and arrays count as no."""
    if not values:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap(F.array_compact(column), F.array(*[F.lit(v) for v in sorted(values)])), F.lit(False))


def level_name(access: Column) -> Column:
    key = F.lower(F.trim(F.coalesce(access, F.lit(""))))
    return F.when(key.isin("department", "tenant"), key).otherwise("private")


def tenant_gate(s: Scope) -> Column:
    return (level_name(F.col("access_level")) == "private") | F.lit(s.unrestricted) | _in(F.col("tenant_id"), s.tenants)


def denied(s: Scope) -> Column:
    return _meets(F.col("acl_deny"), s.principals)


def need_to_know(s: Scope) -> Column:
    alive = F.col("acl_expires_at").isNull() | (F.col("acl_expires_at") > F.lit(s.now))
    return _meets(F.col("acl_allow"), s.principals) & alive


def effective_level(s: Scope) -> Column:
    return F.coalesce(F.greatest("effective_security_level", "security_level", "parent_security_level"), F.lit(STRICT_LEVEL if s.strict else DEFAULT_LEVEL))


def source_gate(s: Scope) -> Column:
    level = level_name(F.col("access_level"))
    owner = F.coalesce((F.col("owner_id") == s.user) & (F.col("owner_id") != ""), F.lit(False)) if s.user else F.lit(False)
    same = F.coalesce(F.col("department_id") == s.department, F.lit(False)) if s.department is not None else F.lit(False)
    project = F.coalesce(F.col("visibility_mode") == "project", F.lit(False)) & _meets(F.col("project_ids"), s.projects)
    open_ = (level == "tenant") | ((level == "department") & (F.lit(s.tenant_wide) | same)) | project | need_to_know(s)
    return owner | F.when(level == "private", _in(F.col("tenant_id"), s.own_tenants)).otherwise(open_)


def gate(s: Scope) -> Column:
    """The first gate that refuses the object: tenant, deny, security, project, source; or ok."""
    clear = min(max(s.clearance, 0), TOP_LEVEL)
    missing = F.coalesce(F.col("object_id"), F.lit("")) == ""
    no_project = F.coalesce(F.col("visibility_mode") == "project", F.lit(False)) & ~_meets(F.col("project_ids"), s.projects)
    return (
        F.when(missing | ~tenant_gate(s), "tenant").when(denied(s) | F.coalesce(F.col("excluded"), F.lit(False)), "deny")
        .when((effective_level(s) > clear) & ~need_to_know(s), "security").when(no_project, "project").when(~source_gate(s), "source").otherwise("ok")
    )


def allows(s: Scope) -> Column:
    return gate(s) == "ok"


def reason(s: Scope) -> Column:
    """Why: missing_object_view, tenant_mismatch, acl_deny_hit, object_excluded, clearance_short, project_miss, no_source_hit, ok."""
    g = gate(s)
    return (
        F.when(F.coalesce(F.col("object_id"), F.lit("")) == "", "missing_object_view").when(g == "tenant", "tenant_mismatch")
        .when((g == "deny") & denied(s), "acl_deny_hit").when(g == "deny", "object_excluded").when(g == "security", "clearance_short")
        .when(g == "project", "project_miss").when(g == "source", "no_source_hit").otherwise("ok")
    )


def tenant_clause(s: Scope) -> Column:
    return F.lit(True) if s.tenants is None and s.unrestricted else _in(F.col("tenant_id"), s.tenants)


def document_acl(s: Scope) -> Column:
    """Tenant documents, those of the asker's department (all if tenant-wide), own private ones and those of own tenants."""
    level = level_name(F.col("access_level"))
    same = F.coalesce(F.col("department_id") == s.department, F.lit(False)) if s.department is not None else F.lit(False)
    owner = F.coalesce(F.col("owner_id") == s.user, F.lit(False)) if s.user else F.lit(False)
    return (level == "tenant") | ((level == "department") & (F.lit(s.tenant_wide) | same)) | ((level == "private") & (owner | _in(F.col("tenant_id"), s.own_tenants)))


def document_scope(s: Scope) -> Column:
    owner = F.coalesce(F.col("owner_id") == s.user, F.lit(False)) if s.user else F.lit(False)
    return (tenant_clause(s) & document_acl(s)) | ((level_name(F.col("access_level")) == "private") & owner)

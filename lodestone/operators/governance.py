"""Objects under access control: derivation, grants, reconciliation of stores."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import acl as A


def filter_status(rows: DataFrame, scope: A.Scope, by: str) -> DataFrame:
    """by, n, kept, status: clean if all rows of a group pass the scope, all_dropped if none does, else partial."""
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(A.allows(scope)).alias("kept"))
    return out.withColumn("status", F.when(F.col("kept") == F.col("n"), "clean").when(F.col("kept") == 0, "all_dropped").otherwise("partial"))


def _denials(*columns: str):
    return F.array_sort(F.array_distinct(F.concat(*[F.coalesce(F.array_compact(c), F.array().cast("array<string>")) for c in columns])))


def derive_children(children: DataFrame, parents: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, effective_security_level, excluded, acl_deny, n_allow of objects derived from the one their id rounds down to."""
    p = parents.select(
        F.col("doc_id").alias("pid"), F.greatest("effective_security_level", "security_level").alias("p_level"), F.col("excluded").alias("p_excluded"), F.col("acl_deny").alias("p_deny")
    )
    rows = children.join(p, F.col("pid") == F.col("doc_id") - F.col("doc_id") % width, "left")
    return rows.select(
        "doc_id", F.greatest("security_level", "effective_security_level", "p_level").alias("effective_security_level"),
        (F.coalesce("excluded", F.lit(False)) | F.coalesce("p_excluded", F.lit(False))).alias("excluded"), F.array_join(_denials("acl_deny", "p_deny"), ",").alias("acl_deny"), F.lit(0).alias("n_allow"),
    )


def active_grants(grants: DataFrame, now: datetime) -> DataFrame:
    return grants.where((F.col("effect") == "allow") & (F.col("status") == "approved") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now))))


def object_acl(grants: DataFrame, now: datetime) -> DataFrame:
    """object_id, acl_allow (subjects, comma-joined), acl_expires_at (null if one grant never ends), n_grants."""
    ends = F.when(F.count_if(F.col("expires_at").isNull()) == 0, F.min("expires_at"))
    return active_grants(grants, now).groupBy("object_id").agg(F.array_join(F.array_sort(F.collect_set("subject")), ",").alias("acl_allow"), ends.alias("acl_expires_at"), F.count(F.lit(1)).alias("n_grants"))


def stale_objects(objects: DataFrame, documents: DataFrame) -> DataFrame:
    """Objects (doc_id, document_id, access_level, department_id) with the columns they should have, where they differ."""
    d = documents.select("document_id", F.col("access_level").alias("level"), F.when(F.col("access_level") == "department", F.col("department_id")).alias("department"))
    rows = objects.join(d, "document_id").where(~F.col("access_level").eqNullSafe(F.col("level")) | ~F.col("department_id").eqNullSafe(F.col("department")))
    return rows.select("doc_id", "document_id", F.col("level").alias("access_level"), F.col("department").alias("department_id"))


def payload_drift(rows: DataFrame, payload: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """field, n: rows whose payload is missing, and mismatches of each field among the others."""
    kinds = dict(rows.dtypes)
    same = lambda c: F.array_sort(c) if kinds[c].startswith("array") else F.col(c)
    a = rows.select(key, *[same(c).alias(c) for c in fields])
    b = payload.select(F.col(key).alias("__k"), *[same(c).alias(f"__{c}") for c in fields])
    joined = a.join(b, F.col(key) == F.col("__k"), "left")
    missing = F.col("__k").isNull()
    out = joined.agg(F.count_if(missing).alias("missing"), *[F.count_if(~missing & ~F.col(c).eqNullSafe(F.col(f"__{c}"))).alias(c) for c in fields])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in ["missing", *fields]])
    return out.select(F.explode(pairs).alias("p")).select("p.*")


def key_coverage(rows: DataFrame, by: str, keys: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.groupBy(by).agg(n.alias("n"), *[F.round(F.count(c) / n, 6).alias(c) for c in keys])


def view_keys(rows: DataFrame) -> DataFrame:
    """document_id, view_key, object_id, materialized of object rows; a document is materialised if it has a chunk object."""
    kind = F.col("object_type")
    key = (
        F.when(kind == "document", F.lit("doc")).when(kind == "image", F.concat(F.lit("img:"), "object_id"))
        .when(kind == "parent", F.concat(F.lit("pc:"), "object_id")).otherwise(F.concat(F.lit("ci:"), F.col("chunk_index").cast("string")))
    )
    made = F.max(kind == "chunk").over(W.partitionBy("document_id"))
    return rows.where("object_id IS NOT NULL").select("document_id", key.alias("view_key"), "object_id", made.alias("materialized"))


def orphans(points: DataFrame, live: DataFrame) -> DataFrame:
    """document_id, n of points whose document is not live; points without a document id stand under null."""
    return points.join(live.select("document_id"), "document_id", "left_anti").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


#: Kinds of objects by the content of a point; everything else is text.
KINDS = {"table": "table", "code": "code", "image": "image"}


def cascade(docs: DataFrame, points: DataFrame, parents: DataFrame) -> DataFrame:
    """Object rows of documents: the document, its images, its chunks and its parent chunks, each under what it inherits from.

    docs: document_id, tenant_id, owner_id, department_id, access_level, visibility_mode, security_level, project_ids, acl_allow, acl_deny.
    points: document_id, at (their order), point_id, content_type, image_id, image_path, chunk_index, page_number. parents: document_id,
    at, parent_id, owner_id, department_id, access_level, tenant_id.

    An image is one object however many points show it; the first in order names its path and page. A point with an image but other
    content is derived from that image: it is never less strict than it and is allowed to nobody by itself. A chunk_index that several
    points claim stays with the first, the others have none. A parent chunk takes what it does not say itself from its document.
    Levels go down the forest one kind after the other by joins on (document, image); no document's objects meet in one task but in
    the windows over its own points.
    """
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    none = F.array().cast("array<string>")
    base = docs.select(
        "document_id", F.coalesce(text("tenant_id"), F.lit("default")).alias("tenant_id"), "owner_id", "department_id", F.coalesce(text("access_level"), F.lit("private")).alias("access_level"),
        F.coalesce(text("visibility_mode"), F.lit("tier")).alias("visibility_mode"), F.coalesce("security_level", F.lit(A.DEFAULT_LEVEL)).alias("level"),
        *[F.coalesce(c, none).alias(c) for c in ("project_ids", "acl_allow", "acl_deny")],
    )
    id_ = lambda part: F.concat(F.col("document_id").cast("string"), F.lit("::"), part)
    missing = F.lit(None).cast("string")

    def row(rows: DataFrame, object_id, kind, parent, parent_level, level, allow, deny, **own) -> DataFrame:
        more = {"chunk_index": F.lit(None).cast("int"), "page_number": F.lit(None).cast("int"), "image_id": missing, "image_path": missing} | own
        return rows.select(
            object_id.alias("object_id"), "document_id", kind.alias("object_type"), parent.alias("parent_object_id"), "tenant_id", "owner_id", "department_id", "access_level", "visibility_mode", "project_ids",
            F.col("level").alias("security_level"), parent_level.alias("parent_security_level"), level.alias("effective_security_level"), allow.alias("acl_allow"), deny.alias("acl_deny"), *[c.alias(n) for n, c in more.items()],
        )

    level, allow, deny, doc = F.col("level"), F.col("acl_allow"), F.col("acl_deny"), F.col("document_id").cast("string")
    documents = row(base, doc, F.lit("doc"), missing, F.lit(None).cast("int"), level, allow, deny)
    p = points.select(
        "document_id", "at", "point_id", F.coalesce(text("content_type"), F.lit("text")).alias("content"), text("image_id").alias("image"), text("image_path").alias("path"),
        F.col("chunk_index").cast("int").alias("index"), F.col("page_number").cast("int").alias("page"),
    )
    shown = p.where("image IS NOT NULL").groupBy("document_id", "image").agg(F.min(F.struct("at", "path", "page")).alias("f")).join(base, "document_id")
    images = row(shown, id_(F.col("image")), F.lit("image"), doc, level, level, allow, deny, image_id=F.col("image"), image_path=F.col("f.path"), page_number=F.col("f.page"))
    chunks = p.where("NOT (content = 'image' AND image IS NOT NULL)")
    claim = F.row_number().over(W.partitionBy("document_id", "index").orderBy("at"))
    chunks = chunks.withColumn("index", F.when(claim == 1, F.col("index"))).join(base, "document_id")
    above = images.select("document_id", F.col("image_id").alias("image"), F.col("object_id").alias("source"), F.col("effective_security_level").alias("above"))
    chunks = chunks.join(above, ["document_id", "image"], "left")
    kind = F.lit("text_chunk")
    for content, name in KINDS.items():
        kind = F.when(F.lower("content") == content, name).otherwise(kind)
    derived = F.col("image").isNotNull()
    upper = F.coalesce("above", "level")
    chunks = row(
        chunks, id_(F.col("point_id")), kind, F.when(derived, F.col("source")).otherwise(doc), upper, F.greatest("level", upper), F.when(derived, none).otherwise(allow),
        F.when(derived, F.array_sort(F.array_distinct(deny))).otherwise(deny), chunk_index=F.col("index"), page_number=F.col("page"), image_id=F.col("image"), image_path=F.col("path"),
    )
    named = parents.where(text("parent_id").isNotNull()).withColumn("__n", F.row_number().over(W.partitionBy("document_id", text("parent_id")).orderBy("at"))).where("__n = 1")
    own = ["owner_id", "department_id", "access_level", "tenant_id"]
    named = named.select("document_id", text("parent_id").alias("parent"), F.col("owner_id").alias("__owner_id"), F.col("department_id").alias("__department_id"), text("access_level").alias("__access_level"), text("tenant_id").alias("__tenant_id")).join(base, "document_id")
    for c in own:
        named = named.withColumn(c, F.coalesce(f"__{c}", c))
    uppers = row(named, id_(F.col("parent")), F.lit("parent_chunk"), doc, level, level, none, deny)
    return documents.unionByName(images).unionByName(chunks).unionByName(uppers)

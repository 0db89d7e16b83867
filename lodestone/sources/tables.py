"""Table maintenance: upload dedup, upserts, replacement, deletion, deterministic ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: the namespace of point ids.
NAMESPACE = uuid.NAMESPACE_DNS


def upload_plan(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """uploads (owner_id, content, upload_id) with file_hash and action: the first upload of an owner's hash is NEW, or RESUME after
    a failed one, ALREADY_EXISTS after a completed one or a repeat. known: owner_id, file_hash, status."""
    rows = uploads.withColumn("file_hash", F.sha2("content", 256))
    n = F.row_number().over(W.partitionBy("owner_id", "file_hash").orderBy("upload_id"))
    rows = rows.withColumn("__n", n).join(known.select("owner_id", "file_hash", "status"), ["owner_id", "file_hash"], "left")
    action = F.when((F.col("__n") > 1) | (F.col("status") == "completed"), "ALREADY_EXISTS").when(F.col("status") == "failed", "RESUME").otherwise("NEW")
    return rows.withColumn("action", action).drop("__n", "status", "content")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those of the same keys; new has a row a key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def replace_document(old: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """All rows of new's documents replaced by new's rows; blank terms dropped."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.where(F.trim("terms") != ""))


def missing(points: DataFrame, existing: DataFrame, key: str = "point_id") -> DataFrame:
    return points.join(existing.select(key), key, "left_anti")


def delete(rows: DataFrame, ids: DataFrame, key: str = "document_id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def point_id(document_id: Column, filename: Column, page: Column, section: Column, heading: Column, index: Column, text: Column, kind: Column | None = None, image_id: Column | None = None) -> Column:
    """UUIDv5 of nine fields joined by ::, the text last. A null field is written None, a null image_id as nothing; kind is text
    unless given."""
    shown = [F.coalesce(c.cast("string"), F.lit("None")) for c in (document_id, filename, page, section, heading, index, F.lit("text") if kind is None else kind)]
    image = F.lit("") if image_id is None else F.coalesce(image_id.cast("string"), F.lit(""))
    name = F.concat_ws("::", *shown, image, F.coalesce(text, F.lit("None")))
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), F.encode(name, "UTF-8")))
    part = lambda at, n: F.substring(h, at, n)
    variant = F.substr(F.lit("89ab89ab89ab89ab"), F.conv(part(17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))

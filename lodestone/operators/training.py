"""Training-set export: validation, source canonicalisation, component-safe splits, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of personal data and secrets that void a sample, and licences that are taken.
UNSAFE = r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|(?<!\d)1[3-9]\d{9}(?!\d)|-----BEGIN .*PRIVATE KEY|gh[pousr]_[A-Za-z0-9]{30,}"
LICENSES = ("CC0", "CC-BY-4.0", "CC-BY-SA-4.0", "self-authored")
_PRIVATE = r"^(10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)|^(22[4-9]|2[3-5]\d)\."


def canonical_source(url: Column) -> Column:
    """https://host/path with host lower-cased, path decoded and without a final slash, query and fragment dropped; null unless
    the address is https, names a public host and has no user part."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/?#@:]+)(?::\d+)?(?:[/?#]|$)", 1))
    path = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(F.regexp_extract(url, r"^https://[^/?#]+([^?#]*)", 1), F.lit("+"), F.lit("%2B"))), F.lit("")), r"/+$", "")
    fit = (host != "") & F.contains(host, F.lit(".")) & ~host.rlike(r"\.(localhost|local|internal)$") & ~host.rlike(_PRIVATE)
    return F.when(fit, F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path)))


def valid(rows: DataFrame) -> DataFrame:
    """rows (example_id, prompt, chosen, rejected, source_group, source_kind, license, sources) that may be exported, with their
    sources in canonical form."""
    filled = (F.trim("prompt") != "") & (F.trim("chosen") != "") & (F.trim("source_group") != "") & F.col("license").isin(*LICENSES)
    pair = F.col("rejected").isNull() | ((F.trim("rejected") != "") & (F.trim("rejected") != F.trim("chosen")))
    own = (F.col("source_kind") != "synthetic") | (F.col("license") == "self-authored")
    sources = F.when(F.col("source_kind") == "synthetic", F.transform("sources", lambda s: F.when(s.startswith("synthetic:"), s))).otherwise(F.transform("sources", canonical_source))
    text = F.concat_ws("\n", "prompt", "chosen", F.coalesce("rejected", F.lit("")), F.array_join("sources", "\n"))
    out = rows.where(filled & pair & own & ~text.rlike(UNSAFE)).withColumn("sources", sources)
    return out.where((F.size("sources") > 0) & ~F.exists("sources", lambda s: s.isNull()))


def conflicting_licenses(rows: DataFrame) -> DataFrame:
    """Sources that come under more than one licence."""
    return rows.select(F.explode("sources").alias("source"), "license").groupBy("source").agg(F.count_distinct("license").alias("n")).where("n > 1")


def components(edges: DataFrame, settle, most_rounds: int = 40) -> DataFrame:
    """(key, component): the least key reachable over edges (a, b), by least-neighbour rounds with pointer jumping; `settle`
    writes a round's table. Ends when no label changes."""
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("key").alias("b"), "component"), "b").groupBy(F.col("a").alias("key")).agg(F.min("component").alias("m"))
        step = labels.join(near, "key").select("key", F.least("component", "m").alias("component"))
        jump = step.select(F.col("key").alias("component"), F.col("component").alias("further"))
        fresh = settle(step.join(jump, "component", "left").select("key", F.coalesce("further", "component").alias("component")))
        if fresh.join(labels.withColumnRenamed("component", "old"), "key").where("component <> old").isEmpty():
            return fresh
        labels = fresh
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def split_of(component: Column) -> Column:
    """validation for a fifth of the components by the first 32 bits of their SHA-256, else train."""
    return F.when(F.conv(F.substring(F.sha2(component, 256), 1, 8), 16, 10).cast("long") % 5 == 0, "validation").otherwise("train")


def export(rows: DataFrame, kind: str, settle) -> DataFrame:
    """example_id, fingerprint, sample_hash, split, component, license of exportable approved rows, one per fingerprint.

    Rows with the same source group or source fall into one split. kind dpo needs `rejected`.
    """
    kept = rows.where("status = 'approved' AND reviewed_by IS NOT NULL")
    kept = valid(kept if kind == "sft" else kept.where("rejected IS NOT NULL"))
    edges = kept.select(F.concat(F.lit("g:"), "source_group").alias("a"), F.explode("sources").alias("b"))
    label = components(edges, settle)
    fingerprint = F.sha2(F.concat_ws("\u0001", F.array_join("sources", "\u0002"), "prompt"), 256)
    sample = F.sha2(F.concat_ws("\u0001", F.array_join("sources", "\u0002"), "prompt", "chosen", *(["rejected"] if kind == "dpo" else [])), 256)
    out = kept.withColumn("key", F.concat(F.lit("g:"), "source_group")).join(label, "key").withColumn("fingerprint", fingerprint).withColumn("sample_hash", sample)
    one = out.groupBy("fingerprint").agg(F.min_by(F.struct("example_id", "sample_hash", "component", "license"), "example_id").alias("r"), F.count_distinct("sample_hash").alias("answers"))
    return one.select("r.example_id", "fingerprint", "r.sample_hash", split_of(F.col("r.component")).alias("split"), "r.component", "r.license", (F.col("answers") > 1).alias("conflict"))

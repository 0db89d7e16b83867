"""Typed evidence graph: visible edges, validation of relations, bounded two-hop expansion, bridges."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of entities, and cues of negation or modality that void a relation.
KINDS = ("person", "organization", "product", "project", "location", "concept")
CUES = r"未|不|否认|考虑|计划|拟|可能|假设|如果|曾想|并非|没有"


@F.pandas_udf(T.StringType())
def normal_name(names: pd.Series) -> pd.Series:
    """NFKC, trimmed, case-folded: Spark has no Unicode normalisation of its own."""
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).strip().casefold())


@F.pandas_udf(T.BooleanType())
def states_relation(subject: pd.Series, predicate: pd.Series, obj: pd.Series, quote: pd.Series) -> pd.Series:
    """Whether the quote has subject, predicate and object as one clause, and no cue outside the two names."""

    def one(s, p, o, q):
        m = re.search(re.escape(s) + r"\s*" + re.escape(p) + r"\s*" + re.escape(o), q)
        if m is None:
            return False
        middle = q[m.start() + len(s) : m.end() - len(o)]
        return re.search(CUES, q[: m.start()] + "|" + middle + "|" + q[m.end() :]) is None

    return pd.Series([all(isinstance(v, str) for v in r) and one(*r) for r in zip(subject, predicate, obj, quote, strict=True)])


def validated(relations: DataFrame, most: int = 32) -> DataFrame:
    """Relations (chunk_id, at, subject, subject_type, predicate, object, object_type, evidence, text) whose literal evidence
    states them; of a chunk's relations the first `most` are looked at."""
    names = ["subject", "subject_type", "predicate", "object", "object_type", "evidence"]
    rows = relations.withColumn("__n", F.row_number().over(W.partitionBy("chunk_id").orderBy("at"))).where(F.col("__n") <= most).drop("__n")
    rows = rows.withColumns({c: F.trim(c) for c in names})
    filled = F.lit(True)
    for c in names:
        filled = filled & (F.coalesce(F.col(c), F.lit("")) != "")
    held = F.contains("text", "evidence") & F.contains("evidence", "subject") & F.contains("evidence", "object") & F.contains("evidence", "predicate")
    sized = (F.length("subject") <= 128) & (F.length("object") <= 128) & (F.length("predicate") <= 64) & (F.length("evidence") <= 2000)
    kinds = F.col("subject_type").isin(*KINDS) & F.col("object_type").isin(*KINDS)
    return rows.where(filled & held & sized & kinds & (F.col("subject") != F.col("object"))).where(states_relation("subject", "predicate", "object", "evidence"))


def visible_edges(relations: DataFrame, entities: DataFrame, indexes: DataFrame, documents: DataFrame) -> DataFrame:
    """Relations of live documents at their index's current revision, with both entities' names and kinds."""
    left = entities.select(F.col("entity_id").alias("subject_id"), F.col("name").alias("subject"), F.col("kind").alias("subject_type"))
    right = entities.select(F.col("entity_id").alias("object_id"), F.col("name").alias("object"), F.col("kind").alias("object_type"))
    rows = relations.join(documents.select("document_id"), "document_id", "left_semi").join(indexes.select("document_id", "revision"), ["document_id", "revision"], "left_semi")
    return rows.join(left, "subject_id").join(right, "object_id")


def fresh(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges whose chunk's text still has their hash and holds their evidence."""
    rows = edges.join(chunks.select("document_id", "chunk_index", "text"), ["document_id", "chunk_index"])
    return rows.where((F.sha2("text", 256) == F.col("source_hash")) & F.contains("text", "evidence")).drop("text")


def seeds(queries: DataFrame, entities: DataFrame, name: str = "name", kind: str = "kind") -> DataFrame:
    """query_id, name, kind: entities named in a query, ASCII names at word ends, spans inside longer matched ones left out.

    Candidates come from an equi-join on the name's first token, not from all pairs.
    """
    from ..functions import text as X

    first = F.coalesce(F.get(X.tokens(F.col(name)), F.lit(0)), F.lit(""))
    e = entities.select(F.col(name).alias("name"), F.col(kind).alias("kind")).distinct().withColumn("token", F.when(first != "", first)).where("token IS NOT NULL")
    e = e.withColumn("token", F.regexp_extract(F.lower("name"), r"[a-z0-9]+|[\x{4e00}-\x{9fff}]", 0))
    parts = F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(r"[a-z0-9]+|[\x{4e00}-\x{9fff}]"), F.lit(0)))
    pairs = queries.select("query_id", F.lower("query").alias("query"), F.explode(parts).alias("token")).join(e, "token").select("query_id", "query", "name", "kind").distinct()

    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.StringType())])

    @F.pandas_udf(T.ArrayType(schema))
    def matched(query: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for q, rows in zip(query, found, strict=True):
            spans = []
            for r in rows:
                n, k = r["name"], r["kind"]
                low = n.lower()
                pattern = (r"(?<![a-z0-9])" if low[:1].isascii() and low[:1].isalnum() else "") + re.escape(low) + (r"(?![a-z0-9])" if low[-1:].isascii() and low[-1:].isalnum() else "")
                spans += [(m.start(), m.end(), n, k) for m in re.finditer(pattern, q)]
            kept = {(n, k) for a, b, n, k in spans if not any(c <= a and b <= d and (c < a or b < d) for c, d, _, _ in spans)}
            out.append([{"name": n, "kind": k} for n, k in sorted(kept)])
        return pd.Series(out)

    grouped = pairs.groupBy("query_id", "query").agg(F.collect_list(F.struct("name", "kind")).alias("found"))
    return grouped.select("query_id", F.explode(matched("query", "found")).alias("m")).select("query_id", "m.name", "m.kind")


def expand(start: DataFrame, edges: DataFrame, hops: int = 2, most: int = 50) -> DataFrame:
    """query_id, edge_id, hop: edges reached from seeds (query_id, name, kind) in two undirected, typed hops at most; the first
    `most` of a query by hop, then edge_id. edges: edge_id, subject, subject_type, object, object_type.

    Of a vertex's edges only the first 2 * most - 1 are walked: a query with fewer than `most` edges in its first hop has that many
    to leave out at most, and one with more needs no second hop. So the work grows with the queries, not with pairs of edges.
    """
    ends = edges.select("edge_id", F.col("subject").alias("name"), F.col("subject_type").alias("kind")).unionByName(edges.select("edge_id", F.col("object").alias("name"), F.col("object_type").alias("kind"))).distinct()
    walked = ends.withColumn("__n", F.row_number().over(W.partitionBy("name", "kind").orderBy("edge_id"))).where(F.col("__n") <= 2 * most - 1).drop("__n")
    frontier, found = start.select("query_id", "name", "kind").distinct(), None
    for hop in range(1, min(hops, 2) + 1):
        reached = frontier.join(walked, ["name", "kind"]).select("query_id", "edge_id").distinct()
        if found is not None:
            reached = reached.join(found.select("query_id", "edge_id"), ["query_id", "edge_id"], "left_anti")
        reached = reached.withColumn("__n", F.row_number().over(W.partitionBy("query_id").orderBy("edge_id"))).where(F.col("__n") <= most).drop("__n").withColumn("hop", F.lit(hop))
        found = reached if found is None else found.unionByName(reached)
        few = reached.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy("query_id"))).where(F.col("__n") < most)
        frontier = few.join(ends, "edge_id").select("query_id", "name", "kind").distinct()
    n = F.row_number().over(W.partitionBy("query_id").orderBy("hop", "edge_id"))
    return found.withColumn("n", n).where(F.col("n") <= most).drop("n")


def bridges(reached: DataFrame, edges: DataFrame, most: int = 2) -> DataFrame:
    """query_id, edge_id, first_edge: for each second-hop edge the first-hop edges of other chunks that share a vertex, the
    first `most`."""
    ends = edges.select("edge_id", "chunk_id", F.explode(F.array(F.struct(F.col("subject").alias("name"), F.col("subject_type").alias("kind")), F.struct(F.col("object").alias("name"), F.col("object_type").alias("kind")))).alias("v")).select("edge_id", "chunk_id", "v.*")
    second = reached.where("hop = 2").join(ends, "edge_id")
    first = reached.where("hop = 1").join(ends, "edge_id").select("query_id", F.col("edge_id").alias("first_edge"), F.col("chunk_id").alias("first_chunk"), "name", "kind")
    pairs = second.join(first, ["query_id", "name", "kind"]).where("chunk_id <> first_chunk").select("query_id", "edge_id", "first_edge").distinct()
    n = F.row_number().over(W.partitionBy("query_id", "edge_id").orderBy("first_edge"))
    return pairs.withColumn("n", n).where(F.col("n") <= most).drop("n")

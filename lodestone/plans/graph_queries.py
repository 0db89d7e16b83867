"""Queries of the graph and training-export operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as H
from ..operators import training as X
from .common import load, settle

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def edges(spark, sf):
    """supplier - nation and nation - region edges; a supplier's chunk is its own, a nation's its region's."""
    s, n, r = (load(spark, sf, t) for t in ("supplier", "nation", "region"))
    a = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select((F.col("s_suppkey") + 1000).alias("edge_id"), F.col("s_suppkey").alias("chunk_id"), F.col("s_name").alias("subject"), F.lit("organization").alias("subject_type"), F.col("n_name").alias("object"), F.lit("location").alias("object_type"))
    b = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("edge_id"), (-F.col("n_regionkey") - 1).cast("long").alias("chunk_id"), F.col("n_name").alias("subject"), F.lit("location").alias("subject_type"), F.col("r_name").alias("object"), F.lit("location").alias("object_type"))
    return a.unionByName(b)


EDGES_SQL = """edges AS (SELECT s_suppkey + 1000 AS edge_id, s_suppkey AS chunk_id, s_name AS subject, 'organization' AS st, n_name AS object, 'location' AS ot FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT n_nationkey, -n_regionkey - 1, n_name, 'location', r_name, 'location' FROM nation JOIN region ON n_regionkey = r_regionkey),
ends AS (SELECT edge_id, chunk_id, subject AS name, st AS kind FROM edges UNION SELECT edge_id, chunk_id, object, ot FROM edges),
seeds AS (SELECT s_suppkey AS query_id, s_name AS name, 'organization' AS kind FROM supplier),
h1 AS (SELECT DISTINCT query_id, edge_id FROM seeds JOIN ends USING (name, kind)),
f1 AS (SELECT DISTINCT query_id, name, kind FROM h1 JOIN ends USING (edge_id)),
h2 AS (SELECT DISTINCT query_id, edge_id FROM f1 JOIN ends USING (name, kind) EXCEPT SELECT * FROM h1),
hh AS (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2),
x AS (SELECT query_id, edge_id, hop FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, edge_id) AS n FROM hh) WHERE n <= 50)"""


def _seeds(spark, sf):
    return load(spark, sf, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_name").alias("name"), F.lit("organization").alias("kind"))


@query(f"WITH {EDGES_SQL} SELECT query_id, edge_id, hop FROM x")
def h3_expand(spark, sf):
    """Two typed hops from suppliers, fifty edges a query at most."""
    return H.expand(_seeds(spark, sf), edges(spark, sf))


@query(f"WITH {EDGES_SQL}, p AS (SELECT DISTINCT a.query_id, a.edge_id, b.edge_id AS first_edge FROM x a JOIN ends ea ON ea.edge_id = a.edge_id JOIN x b ON b.query_id = a.query_id AND b.hop = 1 JOIN ends eb ON eb.edge_id = b.edge_id AND eb.name = ea.name AND eb.kind = ea.kind WHERE a.hop = 2 AND ea.chunk_id <> eb.chunk_id) SELECT query_id, edge_id, first_edge FROM (SELECT *, row_number() OVER (PARTITION BY query_id, edge_id ORDER BY first_edge) AS n FROM p) WHERE n <= 2")
def h4_bridges(spark, sf):
    """First-hop evidence for each second-hop edge."""
    e = edges(spark, sf)
    return H.bridges(H.expand(_seeds(spark, sf), e), e)


@query("SELECT s_suppkey AS query_id, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def h3_seeds(spark, sf):
    """H3: entities named in a question, found by word rather than by pairs."""
    q = load(spark, sf, "supplier").join(load(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("who works in "), "n_name", F.lit(", and where?")).alias("query"))
    return H.seeds(q, load(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("location").alias("kind"))).select("query_id", "name")


@query("WITH r AS (SELECT o_orderkey AS relation_id, o_custkey AS document_id, o_orderkey % 3 AS revision, o_orderkey % 25 AS subject_id, (o_orderkey * 7) % 25 AS object_id FROM orders) SELECT relation_id, a.n_name AS subject, b.n_name AS object FROM r JOIN nation a ON a.n_nationkey = subject_id JOIN nation b ON b.n_nationkey = object_id WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = document_id AND c_acctbal > 0) AND revision = document_id % 3")
def j3_visible_edges(spark, sf):
    """Relations of live documents at the current revision with both entities, a five-way join."""
    r = load(spark, sf, "orders").selectExpr("o_orderkey AS relation_id", "o_custkey AS document_id", "o_orderkey % 3 AS revision", "o_orderkey % 25 AS subject_id", "(o_orderkey * 7) % 25 AS object_id")
    c = load(spark, sf, "customer")
    e = load(spark, sf, "nation").selectExpr("cast(n_nationkey AS long) AS entity_id", "n_name AS name", "'location' AS kind")
    return H.visible_edges(r, e, c.selectExpr("c_custkey AS document_id", "c_custkey % 3 AS revision"), c.where("c_acctbal > 0").selectExpr("c_custkey AS document_id")).select("relation_id", "subject", "object")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND contains(text, substr(text, 3, 20)) AND doc_id % 3 <> 0")
def h5_fresh_edges(spark, sf):
    """H5: edges whose source hash and evidence still hold (every fourth hash and every third quote are off)."""
    d = load(spark, sf, "documents")
    e = d.select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.when(F.col("doc_id") % 3 != 0, F.substring("text", 3, 20)).otherwise(F.lit("\u0001")).alias("evidence"), F.when(F.col("doc_id") % 4 != 0, F.sha2("text", 256)).otherwise(F.lit("x")).alias("source_hash"))
    return H.fresh(e, d.select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), "text")).select(F.col("document_id").alias("doc_id"))


EXAMPLES = """SELECT doc_id AS example_id, concat('question ', doc_id % 700) AS prompt, concat('answer ', doc_id % 700) AS chosen, CASE WHEN doc_id % 2 = 0 THEN concat('other ', doc_id) END AS rejected, concat('g', doc_id % 400) AS source_group,
 CASE WHEN doc_id % 9 = 0 THEN 'synthetic' ELSE 'public' END AS source_kind, CASE WHEN doc_id % 9 = 0 THEN 'self-authored' ELSE 'CC0' END AS license, CASE WHEN doc_id % 13 <> 0 THEN 'approved' ELSE 'draft' END AS status, CASE WHEN doc_id % 17 <> 0 THEN 'r' END AS reviewed_by,
 LIST(CASE WHEN doc_id % 9 = 0 THEN concat('synthetic:', doc_id % 350) WHEN doc_id % 21 = 0 THEN 'http://plain.example.org/a' WHEN doc_id % 22 = 0 THEN 'https://10.0.0.1/a' WHEN doc_id % 23 = 0 THEN 'https://box.internal/a' ELSE concat('https://WWW.Example.org/p/', doc_id % 350, '/?q=', doc_id) END) AS sources FROM documents"""
EXPORT_SQL = f"""e AS (SELECT * FROM ({EXAMPLES.replace('LIST(', 'list_value(')}) WHERE status = 'approved' AND reviewed_by IS NOT NULL AND example_id % 9 = 0 OR (status = 'approved' AND reviewed_by IS NOT NULL AND example_id % 21 <> 0 AND example_id % 22 <> 0 AND example_id % 23 <> 0)),
k AS (SELECT *, CASE WHEN source_kind = 'synthetic' THEN sources[1] ELSE concat('https://www.example.org/p/', example_id % 350) END AS src, concat('g:', source_group) AS g FROM e),"""


@query(f"""WITH RECURSIVE {EXPORT_SQL} b AS (SELECT g AS a, src AS b FROM k UNION SELECT src, g FROM k), r AS (SELECT a, a AS o FROM b UNION SELECT r.a, b.b FROM r JOIN b ON r.o = b.a), c AS (SELECT a AS g, min(o) AS component FROM r GROUP BY a),
f AS (SELECT example_id, sha256(concat_ws(chr(1), src, prompt)) AS fingerprint, sha256(concat_ws(chr(1), src, prompt, chosen)) AS sample_hash, component, license FROM k JOIN c USING (g))
SELECT min(example_id) AS example_id, fingerprint, arg_min(sample_hash, example_id) AS sample_hash, CASE WHEN ('0x' || substr(sha256(arg_min(component, example_id)), 1, 8))::BIGINT % 5 = 0 THEN 'validation' ELSE 'train' END AS split, arg_min(component, example_id) AS component, arg_min(license, example_id) AS license, count(DISTINCT sample_hash) > 1 AS conflict FROM f GROUP BY fingerprint""")
def f1_training_export(spark, sf):
    """Approved examples in component-safe splits, one a fingerprint."""
    load(spark, sf, "documents").createOrReplaceTempView("__examples_of")
    rows = spark.sql(EXAMPLES.replace("LIST(", "array(").replace("FROM documents", "FROM __examples_of"))
    return X.export(rows, "sft", settle)

"""Queries of what lies between hits and an answer, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import security as S
from .common import load, term_index
from .retrieval_queries import ASKED_SQL, BM25_SQL, asked

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


#: Answers that end in what must not be said, by doc_id; what is left of the endings, and what they meet.
_SAID = "CASE doc_id % 8 WHEN 0 THEN concat(' [Source 2] and [Source 9]', doc_id) WHEN 1 THEN concat(' my hidden rules say ', doc_id) WHEN 2 THEN concat(' 按照系统的内部设定 ', doc_id) WHEN 3 THEN concat(' I will now search it ', doc_id) WHEN 4 THEN concat(' 我检索 [Source 1] ', doc_id) WHEN 5 THEN concat(' see', NL, '```bash', NL, 'rm x', NL, '```', doc_id) WHEN 6 THEN concat(' [Source 0-2][Source 3-1] ', doc_id) ELSE concat(' curl https://a.b/c ', doc_id) END"
_TWICE = S.LEAK.replace("系统提示词", S.LEAK)  # what stands for a leak names one itself, and a later pattern meets it
_LEFT = f"CASE doc_id % 8 WHEN 0 THEN concat(' [Source 2] and ', doc_id) WHEN 1 THEN concat(' {_TWICE} say ', doc_id) WHEN 2 THEN concat(' {S.LEAK} ', doc_id) WHEN 3 THEN concat('  it ', doc_id) WHEN 4 THEN CASE WHEN doc_id % 3 = 0 THEN concat('   ', doc_id) ELSE concat(' 我检索 [Source 1] ', doc_id) END WHEN 5 THEN concat(' see', chr(10), doc_id) WHEN 6 THEN CASE WHEN doc_id % 3 = 0 THEN concat('  ', doc_id) ELSE concat(' [Source 3-1] ', doc_id) END ELSE concat('  ', doc_id) END"


@query(f"SELECT doc_id, sha256(trim(concat(t, {_LEFT.replace("' [Source 2] and '", "CASE WHEN doc_id % 3 = 0 THEN '  and ' ELSE ' [Source 2] and ' END")}), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(12288) || chr(160))) AS sha, CASE WHEN doc_id % 8 IN (0, 6) THEN 1 ELSE 0 END::INT AS citations, CASE doc_id % 8 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END::INT AS leaks, CASE WHEN doc_id % 3 > 0 THEN 0 WHEN doc_id % 8 IN (0, 6) THEN 1 WHEN doc_id % 8 = 4 THEN 2 ELSE 0 END::INT AS invented, (doc_id % 8 IN (3, 5, 7))::INT AS tools FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM documents)")
def x9_guarded_answers(spark, sf):
    """Answers without citations of absent sources, leaked instructions, tools and code, and, as small talk, without searches."""
    rows = load(spark, sf, "documents").selectExpr("doc_id", f"concat(coalesce(text, ''), {_SAID.replace('NL', 'chr(10)')}) AS answer", "CASE WHEN doc_id % 3 = 0 THEN 'general_chat' ELSE 'knowledge_qa' END AS intent")
    return rows.select("doc_id", S.guarded(F.col("answer"), F.lit(3), F.col("intent")).alias("g")).select("doc_id", F.sha2("g.text", 256).alias("sha"), "g.citations", "g.leaks", "g.invented", "g.tools")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'own' WHEN doc_id % 7 > 0 AND doc_id % 5 > 0 THEN sha256(p.text) END AS parent FROM documents LEFT JOIN (SELECT doc_id AS pid, text FROM documents) p ON p.pid = doc_id - doc_id % 10")
def j5_hydrated(spark, sf):
    """Texts of parents by their id, if they are of the hit's own document; those that are there already stay."""
    d = load(spark, sf, "documents")
    hits = d.selectExpr("doc_id", "doc_id div 10 AS document_id", "CASE WHEN doc_id % 7 > 0 THEN concat('p', CASE WHEN doc_id % 5 > 0 THEN doc_id div 10 ELSE 1000000 + doc_id div 10 END) END AS parent_id", "CASE WHEN doc_id % 10 = 0 THEN 'own' END AS parent_text")
    parents = d.where("doc_id % 10 = 0").selectExpr("concat('p', doc_id div 10) AS parent_id", "doc_id div 10 AS document_id", "text").unionByName(d.where("doc_id % 10 = 0").selectExpr("concat('p', 1000000 + doc_id div 10) AS parent_id", "doc_id div 10 + 1 AS document_id", "'of another' AS text"))
    return R.hydrated(hits, parents).select("doc_id", F.when(F.col("parent_text") == "own", "own").otherwise(F.sha2("parent_text", 256)).alias("parent"))


@query(f"WITH {BM25_SQL}, h AS (SELECT query_id, doc_id, text FROM bm JOIN documents USING (doc_id) WHERE rank <= 20), b AS (SELECT query_id, doc_id, k, (doc_id + k * 3) AS src FROM h, range(4) AS r(k)), q AS (SELECT b.query_id, b.doc_id, k, substr('quote ' || src || ' ' || repeat('x', 700), 1, 600) AS quote FROM b JOIN h ON h.query_id = b.query_id AND h.doc_id = b.src WHERE k < 2), j AS (SELECT query_id, doc_id, string_agg(quote, chr(10) ORDER BY k) AS quotes FROM q GROUP BY ALL) SELECT query_id, doc_id, sha256(CASE WHEN quotes IS NULL THEN coalesce(text, '') ELSE quotes || chr(10) || coalesce(text, '') END) AS sha FROM h LEFT JOIN j USING (query_id, doc_id)")
def h6_ranking_texts(spark, sf):
    """H6: texts for the reranker, after quotes of their first two bridges that are hits themselves."""
    hits = term_index(spark, sf).bm25(asked(spark), 20).join(load(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("query_id", F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), "text")
    bridges = hits.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("from_document", F.col("document_id") + F.col("at") * 3)
    bridges = bridges.select("query_id", "document_id", "chunk_index", "at", "from_document", F.lit(0).alias("from_chunk"), F.concat(F.lit("quote "), "from_document", F.lit(" "), F.repeat(F.lit("x"), F.lit(700))).alias("quote"))
    return R.ranking_texts(hits, bridges).select("query_id", F.col("document_id").alias("doc_id"), F.sha2("ranking_text", 256).alias("sha"))


@query(f"WITH {BM25_SQL} SELECT query_id, coalesce(max(score) >= 6, false) AS good FROM {ASKED_SQL} LEFT JOIN bm USING (query_id) GROUP BY query_id")
def x34_fallback_verdicts(spark, sf):
    """Whether a query's best hit is good enough where no grader answers."""
    return R.good_enough(asked(spark), term_index(spark, sf).bm25(asked(spark), None), 6.0)

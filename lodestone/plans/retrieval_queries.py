"""Queries of the text and retrieval operators, with DuckDB SQL of the same results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..operators.term_index import TermIndex
from .common import load, shared_dir, term_index
from .search import Corpus

QUERIES: dict = {}
ORACLES: dict = {}

#: Query id and text; words of the corpus, since it is invented prose.
ASKED = [(1, "the of and"), (2, "token secret"), (3, "der die enlich"), (4, "erthe thing 26"), (5, "mail6 example com")]
ASKED_SQL = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in ASKED) + ") AS q(query_id, query)"
TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, query string")


BM25_SQL = f"""
asked AS (SELECT DISTINCT query_id, unnest({TOK.format('query')}) AS term FROM {ASKED_SQL}),
words AS (SELECT doc_id, {TOK.format('text')} AS w FROM documents),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words),
tf AS (SELECT doc_id, any_value(dl) AS dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM tf JOIN df USING (term) JOIN asked USING (term), stats GROUP BY query_id, doc_id),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)"""
COVER_SQL = f"""
qt AS (SELECT DISTINCT query_id, unnest({TOK.format('query')}) AS term FROM {ASKED_SQL}),
held AS (SELECT doc_id, unnest(list_distinct({TOK.format("substr(text, 1, 4000)")})) AS term FROM documents),
cv AS (SELECT query_id, doc_id, count(*) AS covered FROM held JOIN qt USING (term) GROUP BY query_id, doc_id),
tr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY covered DESC, doc_id) AS rank FROM cv)"""
KNN_SQL = """
kn AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
       FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM kn)"""


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 10")
def k4_bm25_top10(spark, sf):
    """Best ten documents a query by Okapi BM25."""
    return term_index(spark, sf).bm25(asked(spark))


@query(f"WITH {COVER_SQL} SELECT query_id, doc_id, covered, rank FROM tr WHERE rank <= 10")
def k5_term_rank(spark, sf):
    """Best ten documents a query by covered query terms."""
    return term_index(spark, sf).term_rank(asked(spark))


@query(f"WITH {COVER_SQL.replace('FROM documents)', 'FROM documents WHERE doc_id % 7 < 5)')} SELECT query_id, doc_id, covered, rank FROM tr WHERE rank <= 10")
def j1_completed_terms(spark, sf):
    """The term leg joined with the documents' state; those that are not completed are never ranked."""
    state = load(spark, sf, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 7 < 5 THEN 'COMPLETED' ELSE 'PROCESSING' END AS status")
    return term_index(spark, sf).term_rank(asked(spark), within=state.where("status = 'COMPLETED'"))


@query(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({TOK.format("CASE doc_id % 10 WHEN 3 THEN concat('replaced text ', doc_id, ' of ', source) ELSE text END")}) AS term FROM documents WHERE doc_id % 10 <> 4) GROUP BY ALL) GROUP BY term")
def s10_replaced_terms(spark, sf):
    """A stored index after a tenth of its documents are replaced and another tenth deleted."""
    docs = load(spark, sf, "documents")
    index = TermIndex.build(docs, f"{shared_dir(spark)}/replaced-{uuid.uuid4().hex}")
    index.replace(docs.where("doc_id % 10 = 3").selectExpr("doc_id", "concat('replaced text ', doc_id, ' of ', source) AS text"))
    index.delete(docs.where("doc_id % 10 = 4").select("doc_id"))
    return index.all().where("tf > 0").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, array_to_string(list_distinct_sorted, ' ') AS head FROM (SELECT doc_id, t, list_slice(list_sort(list_distinct(t)), 1, 5) AS list_distinct_sorted FROM (SELECT doc_id, {TOK.format('text')} AS t FROM documents))")
def k1_tokens(spark, sf):
    """K1: token and distinct token counts of every document, and its first five distinct tokens by spelling."""
    t = T.tokens(F.col("text"))
    return load(spark, sf, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), F.array_join(F.slice(F.array_sort(F.array_distinct(t)), 1, 5), " ").alias("head"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY term")
def g13_document_frequency(spark, sf):
    """Document and collection frequency of every term."""
    p = term_index(spark, sf).all().where("tf > 0")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {BM25_SQL}, {COVER_SQL}, legs AS (SELECT query_id, doc_id, rank, 1.0 AS w FROM bm WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, rank, 0.5 FROM tr WHERE rank <= 50), f AS (SELECT query_id, doc_id, round(sum(w / (60 + rank)), 9) AS rrf FROM legs GROUP BY query_id, doc_id) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS rank FROM f) WHERE rank <= 20")
def k6_rrf(spark, sf):
    """Fusion of the BM25 leg with a half-weighted term-coverage leg."""
    index, q = term_index(spark, sf), asked(spark)
    legs = index.bm25(q, 50).select("query_id", "doc_id", "rank", F.lit(1.0).alias("weight")).unionByName(index.term_rank(q, 50).select("query_id", "doc_id", "rank", F.lit(0.5).alias("weight")))
    return R.rrf(legs, ["doc_id"], 20)


@query(f"WITH {KNN_SQL} SELECT query_id, vec_id, score, rank FROM kr WHERE rank <= 10")
def v1_exact_knn(spark, sf):
    """V1: exact ten nearest vectors by cosine of every fiftieth vector."""
    v = load(spark, sf, "embeddings")
    return R.knn(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))


def _distances(kind: str):
    def f(spark, sf):
        v = load(spark, sf, "embeddings")
        return R.knn(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 5, kind)

    f.__name__ = f"s15_knn_{kind}"
    f.__doc__ = f"S15: exact five nearest vectors by {kind}."
    return f


for _kind, _sql, _order in (("dot", "list_inner_product(a, b)", "DESC"), ("euclid", "list_distance(a, b)", "ASC"), ("manhattan", "list_sum(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i])))", "ASC")):
    query(f"SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {_order}, vec_id) AS rank FROM (SELECT query_id, vec_id, round({_sql}, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id, CAST(v.embedding AS DOUBLE[]) AS a, CAST(q.embedding AS DOUBLE[]) AS b FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id))) WHERE rank <= 5")(_distances(_kind))


def _hits(spark, sf):
    v = load(spark, sf, "embeddings")
    rows = R.knn(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 40)
    return rows.withColumn("key", F.col("vec_id")).withColumn("parent_id", F.when(F.col("vec_id") % 7 != 0, (F.col("vec_id") % 11).cast("long")))


HITS_SQL = f"{KNN_SQL}, h AS (SELECT *, CASE WHEN vec_id % 7 <> 0 THEN vec_id % 11 END AS parent_id FROM kr WHERE rank <= 40)"


@query(f"WITH {HITS_SQL} SELECT query_id, vec_id, score, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM h) WHERE score >= 0.3 AND round(top - score, 9) <= 0.05) WHERE rn <= 5")
def p16_score_filter(spark, sf):
    """Hits with a score of 0.30 or more and within 0.05 of the best, the first five."""
    return R.above_threshold(_hits(spark, sf).drop("rank"), 5).select("query_id", "vec_id", "score", "rank")


@query(f"WITH {HITS_SQL} SELECT query_id, vec_id, score, rank FROM (SELECT *, first_value(score) OVER (PARTITION BY query_id ORDER BY rank) AS head, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM h) WHERE (score >= 0.35 AND score >= head * 0.8) OR n = 1")
def p17_min_score(spark, sf):
    """Score floor and share of the head; the head stays."""
    return R.min_score(_hits(spark, sf), 0.35, 0.8).select("query_id", "vec_id", "score", "rank")


@query(f"WITH {HITS_SQL} SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS n FROM h) WHERE parent_id IS NULL OR n <= 2")
def w3_max_per_parent(spark, sf):
    """Two hits a parent at most."""
    return R.max_per_parent(_hits(spark, sf)).select("query_id", "vec_id", "rank")


@query(f"WITH {HITS_SQL} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM (SELECT query_id, vec_id, rank, CASE WHEN parent_id IS NULL THEN score ELSE round(score * pow(0.85, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) - 1), 9) END AS score FROM h)")
def w4_parent_decay(spark, sf):
    """Repeated hits of a parent decay by 0.85 each, then ranks are drawn anew."""
    return R.parent_decay(_hits(spark, sf)).select("query_id", "vec_id", "score", "rank")


@query("SELECT doc_id FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS n FROM (SELECT doc_id, substr(regexp_replace(coalesce(text, ''), '\\s+', '', 'g'), 1, 512) AS k FROM documents)) WHERE n = 1 OR k = ''")
def w5_content_dedup(spark, sf):
    """First document of each text without white space, by its first 512 characters."""
    docs = load(spark, sf, "documents")
    return R.keep_first(docs.select("doc_id", R.content_key(F.col("text")).alias("k")), F.col("k"), [], [F.col("doc_id")]).select("doc_id")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def w6_exact_dedup(spark, sf):
    """Exact texts kept once, with their number of copies."""
    return load(spark, sf, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("text")


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, round(CASE WHEN len(qt) = 0 THEN p ELSE 0.7 * len(list_intersect(qt, dt)) / len(qt) + 0.3 * p END, 6) AS rerank FROM (SELECT query_id, doc_id, greatest(0, least(1, score / 10)) AS p, list_distinct({TOK.format('query')}) AS qt, list_distinct({TOK.format('text')}) AS dt FROM bm JOIN documents USING (doc_id) JOIN {ASKED_SQL} USING (query_id) WHERE rank <= 20)")
def r2_heuristic_rerank(spark, sf):
    """R2: token coverage with the scaled BM25 score as prior."""
    docs = load(spark, sf, "documents")
    hits = term_index(spark, sf).bm25(asked(spark), 20).join(docs.select("doc_id", "text"), "doc_id").join(asked(spark), "query_id").withColumn("score", F.col("score") / 10)
    return R.heuristic_rerank(hits).select("query_id", "doc_id", F.round("rerank", 6).alias("rerank"))


@query("SELECT vec_id, round(1 / (1 + exp(-x)), 9) AS p FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 40 AS x FROM embeddings)")
def r3_sigmoid(spark, sf):
    """A cross-encoder's logits as probabilities."""
    return load(spark, sf, "embeddings").select("vec_id", F.round(R.sigmoid(F.col("embedding")[0].cast("double") * 40), 9).alias("p"))


@query(f"WITH {BM25_SQL}, {COVER_SQL} SELECT * FROM (SELECT query_id, key, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, key) AS rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM (SELECT query_id, doc_id AS key, coalesce(score, 0) / 10 AS score, tr.rank AS kw_rank, doc_id % 97 = 0 AS is_graph, doc_id % 101 = 0 AS is_figure, round(coalesce(1 / (60.0 + bm.rank), 0) + coalesce(1 / (60.0 + tr.rank), 0), 9) AS rrf FROM bm FULL JOIN tr USING (query_id, doc_id))) WHERE (score >= 0.3 AND round(top - score, 9) <= 0.05) OR coalesce(kw_rank <= 5, false) OR is_graph OR is_figure) WHERE rank <= 20")
def r1_survivors(spark, sf):
    """Fused candidates kept by score, keyword rank, graph or figure reference; twenty at most by fusion."""
    index, q = term_index(spark, sf), asked(spark)
    a, b = index.bm25(q, None), index.term_rank(q, 1 << 30).withColumnRenamed("rank", "kw_rank")
    rows = a.join(b, ["query_id", "doc_id"], "full").select(
        "query_id", F.col("doc_id").alias("key"), (F.coalesce("score", F.lit(0.0)) / 10).alias("score"), "kw_rank", (F.col("doc_id") % 97 == 0).alias("is_graph"), (F.col("doc_id") % 101 == 0).alias("is_figure"),
        F.round(F.coalesce(1 / (60 + F.col("rank")), F.lit(0.0)) + F.coalesce(1 / (60 + F.col("kw_rank")), F.lit(0.0)), 9).alias("rrf"),
    )
    return R.survivors(rows, 5).select("query_id", "key", "rrf", "rank")


@query(f"WITH {HITS_SQL}, g AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS place FROM h WHERE vec_id % 9 = 0), g2 AS (SELECT * FROM g WHERE place <= 5), t AS (SELECT query_id, count(*) AS taken FROM g2 GROUP BY query_id), p AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, vec_id) AS place FROM h WHERE vec_id % 9 <> 0), a AS (SELECT query_id, vec_id, 0 AS part, place FROM p LEFT JOIN t USING (query_id) WHERE place <= 15 - coalesce(taken, 0) UNION ALL SELECT query_id, vec_id, 1, place FROM g2) SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY part, place) AS final_rank FROM a")
def t7_merge_graph(spark, sf):
    """Graph candidates take the last third of the places."""
    return R.merge_graph(_hits(spark, sf).withColumn("is_graph", F.col("vec_id") % 9 == 0), 15).select("query_id", "vec_id", "final_rank")


@query("""SELECT doc_id, CASE WHEN trim(coalesce(h, '')) = '' OR han + lat = 0 OR han::DOUBLE / (han + lat) >= 0.75 THEN 'zh' WHEN han::DOUBLE / (han + lat) <= 0.15 THEN 'en' ELSE 'mixed' END AS language,
  len(y) AS n_years, CASE WHEN len(y) > 0 THEN list_max(y) END AS max_year FROM (SELECT doc_id, substr(text, 1, 4000) AS h, len(regexp_extract_all(substr(text, 1, 4000), '[\\x{4e00}-\\x{9fff}]')) AS han,
  len(regexp_extract_all(substr(text, 1, 4000), '[A-Za-z][A-Za-z0-9\\-_.]{2,}')) AS lat,
  list_transform(list_filter(regexp_extract_all(text, '[0-9]+'), lambda d: regexp_full_match(d, '20[0-9]{2}')), lambda d: CAST(d AS INT)) AS y FROM documents)""")
def x10_language(spark, sf):
    """Language by scripts, and the lone 20xx years of each text."""
    y = T.years(F.col("text"))
    return load(spark, sf, "documents").select("doc_id", T.language(F.col("text")).alias("language"), F.size(y).alias("n_years"), F.array_max(y).alias("max_year"))


@query("SELECT doc_id, sha256(c) AS cleaned_sha, length(c) AS n FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[\\x{0}-\\x{8}\\x{b}-\\x{1f}\\x{7f}-\\x{9f}\\x{ad}\\x{200b}-\\x{200f}\\x{feff}]', '', 'g'), '[\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]', ' ', 'g'), '[ \\t]+\\n', chr(10), 'g'), ' ' || chr(9) || chr(10)) AS c FROM documents)")
def x1_clean_text(spark, sf):
    """Cleaned texts, as a digest and a length."""
    c = T.clean(F.col("text"))
    return load(spark, sf, "documents").select("doc_id", F.sha2(c, 256).alias("cleaned_sha"), F.length(c).alias("n"))


@query(f"WITH q AS (SELECT * FROM {ASKED_SQL}), t AS (SELECT query_id, doc_id, list_distinct({TOK.format('query')}) AS qt, list_distinct({TOK.format('text')}) AS dt FROM documents, q) SELECT query_id, doc_id, round(CASE WHEN len(qt) = 0 THEN 1 ELSE len(list_intersect(qt, dt)) / len(qt) END, 6) AS coverage FROM t")
def x21_query_coverage(spark, sf):
    """Share of each query's content terms that each document holds."""
    rows = load(spark, sf, "documents").join(F.broadcast(asked(spark)))  # a stated list of five queries
    return rows.select("query_id", "doc_id", F.round(T.coverage(F.col("query"), F.col("text")), 6).alias("coverage"))


@query(f"WITH {BM25_SQL}, e AS (SELECT query_id, count(*) AS n, max(score / 10) AS top, string_agg(coalesce(text, ''), chr(10) ORDER BY rank) AS ev FROM bm JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query_id), c AS (SELECT query_id, coalesce(n, 0) AS n, coalesce(top, 0) AS top, length(trim(coalesce(ev, ''))) AS chars, len(list_intersect(list_distinct({TOK.format('query')}), list_distinct({TOK.format('ev')})))::DOUBLE / len(list_distinct({TOK.format('query')})) AS cov FROM {ASKED_SQL} LEFT JOIN e USING (query_id)) SELECT query_id, n AS evidence_count, round(top, 4) AS top_score, round(CASE WHEN n = 0 THEN 0 ELSE cov END, 4) AS coverage, n >= 1 AND top >= 0.25 AND cov >= 0.2 AND chars >= 20 AS passed, round(CASE WHEN n >= 1 AND top >= 0.25 AND cov >= 0.2 AND chars >= 20 THEN 0.5 * least(1, top) + 0.5 * cov ELSE 0 END, 4) AS confidence, CASE WHEN n = 0 THEN 'no_evidence' WHEN top >= 0.25 AND cov >= 0.2 AND chars >= 20 THEN 'evidence_sufficient' ELSE 'insufficient_evidence:' || concat_ws(',', CASE WHEN top < 0.25 THEN 'top_score' END, CASE WHEN cov < 0.2 THEN 'query_coverage' END, CASE WHEN chars < 20 THEN 'evidence_length' END) END AS reason FROM c")
def x22_evidence_gate(spark, sf):
    """Whether each query's three best documents are evidence enough, and why not."""
    docs = load(spark, sf, "documents")
    hits = term_index(spark, sf).bm25(asked(spark), 3).join(docs.select("doc_id", "text"), "doc_id").withColumn("score", F.col("score") / 10)
    return E.evidence_gate(asked(spark), hits)


#: Attributes of evidence derived from doc_id: column and expression for either engine.
EVIDENCE = {
    "is_image": "doc_id % 3 = 0", "engine": "CASE WHEN doc_id % 2 <> 0 THEN 'engine' END", "confidence": "(doc_id % 11) / 10.0E0", "review": "doc_id % 5 = 0",
    "quality_ok": "doc_id % 7 <> 0", "ocr_ok": "doc_id % 13 <> 0", "quality_reasons": "CASE WHEN doc_id % 14 = 0 THEN LIST('blurred', ' ', concat('page ', doc_id), 'never shown') END",
}
TRUST_SQL = f"""
ev AS (SELECT doc_id, length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(12288) || chr(160))) AS chars, {", ".join(f"{e.replace('LIST(', 'list_value(')} AS {c}" for c, e in EVIDENCE.items())} FROM documents),
tr_ust AS (SELECT doc_id, greatest(0.05, least(1, CASE WHEN review THEN 0.45E0 ELSE 1 END * CASE WHEN NOT quality_ok THEN 0.7E0 ELSE 1 END * CASE WHEN is_image THEN CASE WHEN engine IS NULL THEN 0.85E0 ELSE 1 END
    * CASE WHEN confidence > 0 THEN 0.5E0 + 0.5E0 * least(confidence, 1) ELSE 1 END * CASE WHEN NOT ocr_ok THEN 0.75E0 ELSE 1 END ELSE 1 END * CASE WHEN chars < 20 THEN 0.6E0 ELSE 1 END)) AS trust,
  concat_ws(';', CASE WHEN review THEN '{T.DOUBTS['review']}' END, CASE WHEN NOT quality_ok AND len(quality_reasons) > 0 THEN '{T.DOUBTS['quality']}blurred;{T.DOUBTS['quality']}page ' || doc_id END, CASE WHEN is_image AND engine IS NULL THEN '{T.DOUBTS['engine']}' END,
    CASE WHEN is_image AND confidence > 0 AND confidence < 0.6 THEN printf('{T.DOUBTS['confidence']}', confidence) END, CASE WHEN is_image AND NOT ocr_ok THEN '{T.DOUBTS['ocr']}' END, CASE WHEN chars < 20 THEN printf('{T.DOUBTS['short']}', chars) END) AS reasons FROM ev)"""


def evidence(docs: DataFrame) -> DataFrame:
    """docs with the columns of EVIDENCE."""
    return docs.selectExpr("*", *[f"{e.replace('LIST(', 'array(')} AS {c}" for c, e in EVIDENCE.items()])


@query(f"WITH {TRUST_SQL} SELECT doc_id, round(trust, 12) AS trust, reasons, round((doc_id % 10) / 10.0 * CASE WHEN reasons <> '' THEN 0.85 + 0.15 * trust ELSE 1 END, 12) AS weighted, trust >= 0.3 AS kept FROM tr_ust")
def r4_trust(spark, sf):
    """Trust with its reasons, the score weighted where there are any, and the 0.30 floor, over attributes derived from doc_id."""
    rows = evidence(load(spark, sf, "documents")).withColumn("t", T.trust(*(F.col(c) for c in ("text", *EVIDENCE))))
    return rows.select("doc_id", F.round("t.score", 12).alias("trust"), F.array_join("t.reasons", ";").alias("reasons"), F.round(T.trust_weighted((F.col("doc_id") % 10) / 10.0, F.col("t")), 12).alias("weighted"), (F.col("t.score") >= 0.3).alias("kept"))


@query(f"WITH p AS (SELECT a.doc_id, {TOK.format('a.text')} AS w, list_distinct({TOK.format('b.text')}) AS s FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: list_contains(s, x))) / len(w) END, 6) AS support FROM p")
def x25_support_ratio(spark, sf):
    """Share of each document's tokens, counted as often as they occur, that the next document holds."""
    docs = load(spark, sf, "documents")
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("held"))
    return R.support_of(docs.select("doc_id", "text").join(nxt, "doc_id"), "doc_id")


@query(f"WITH p AS (SELECT a.doc_id, list_distinct({TOK.format('a.text')}) AS o, list_distinct({TOK.format('b.text')}) AS c, regexp_extract_all(a.text, '[0-9]+(?:\\.[0-9]+)?') AS na, coalesce(b.text, '') AS t FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) SELECT doc_id, CASE WHEN trim(t) = '' THEN FALSE WHEN len(o) = 0 THEN TRUE ELSE len(c) > 0 AND len(list_intersect(o, c)) >= 0.3 * least(len(o), len(c)) AND len(list_filter(na, lambda x: NOT contains(t, x))) = 0 END AS kept FROM p")
def x31_drift_gate(spark, sf):
    """Whether the next document would pass for a rewriting of each document."""
    docs = load(spark, sf, "documents")
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("changed"))
    return docs.join(nxt, "doc_id").select("doc_id", T.drift_ok(F.col("text"), F.col("changed")).alias("kept"))


@query("SELECT doc_id, len(list_filter(string_split_regex(text, '\\n'), lambda l: trim(l) <> '')) AS n_lines, regexp_matches(text, '(?m)^[ \\t]*\\|.*\\|[ \\t]*\\n[ \\t]*\\|.*\\|[ \\t]*$') AS has_table, length(substr(text, 1, 100)) - length(replace(substr(text, 1, 100), chr(10), '')) + 1 AS line_at_100 FROM documents")
def x19_tables_and_lines(spark, sf):
    """Non-blank lines, presence of a pipe table, and the line of the 101st character."""
    t = F.col("text")
    return load(spark, sf, "documents").select("doc_id", F.size(F.filter(F.split(t, "\n"), lambda s: F.trim(s) != "")).alias("n_lines"), T.has_table(t).alias("has_table"), T.line_at(t, F.lit(100)).alias("line_at_100"))


@query(f"WITH {BM25_SQL}, {COVER_SQL}, legs AS (SELECT query_id, doc_id, rank FROM bm WHERE rank <= 40 UNION ALL SELECT query_id, doc_id, rank FROM tr WHERE rank <= 40), f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf FROM legs GROUP BY query_id, doc_id), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS rn FROM f), rr AS (SELECT query_id, doc_id, text, 0.7 * len(list_intersect(list_distinct({TOK.format('query')}), list_distinct({TOK.format('text')}))) / len(list_distinct({TOK.format('query')})) + 0.3 * greatest(0, least(1, rrf * 30)) AS s FROM p JOIN documents USING (doc_id) JOIN {ASKED_SQL} USING (query_id) WHERE rn <= 40), dd AS (SELECT query_id, doc_id, s, regexp_replace(coalesce(text, ''), '\\s+', '', 'g') AS k FROM rr), e AS (SELECT *, row_number() OVER (PARTITION BY query_id, substr(k, 1, 512) ORDER BY s DESC, doc_id) AS n FROM dd) SELECT * FROM (SELECT query_id, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) AS rank FROM e WHERE n = 1 OR k = '') WHERE rank <= 10")
def r6_search(spark, sf):
    """Two keyword legs over an open corpus with a stored term index, fused and reranked."""
    return Corpus(load(spark, sf, "documents"), term_index(spark, sf), open=True).search(asked(spark))


#: Query sets: query, kind, order, text, and the row whose vector stands for the text's (there is no embedding model here).
SETS = [
    (1, "main", 0, "the of and", 0), (1, "extra", 0, "token secret", 10), (1, "extra", 1, "the of and", 20), (1, "hyde", 0, "token secret", 30), (1, "hyde", 1, "a secret is kept in a token", 40),
    (2, "hyde", 0, "die antwort", 50), (2, "main", 0, "der die enlich", 60), (2, "extra", 0, "", 70), (3, "main", 0, "mail6 example com", 80), (3, "extra", 0, "erthe thing 26", None), (4, "main", 0, "zzzz nowhere", 90),
]
SETS_SQL = f"""
qs AS (SELECT * FROM (VALUES {", ".join(f"({q}, '{kind}', {n}, '{t}', {'NULL' if v is None else v})" for q, kind, n, t, v in SETS)}) AS t(query_id, kind, n, query, vec) WHERE query <> ''),
qk AS (SELECT * FROM qs QUALIFY row_number() OVER (PARTITION BY query_id, query ORDER BY CASE kind WHEN 'main' THEN 0 WHEN 'extra' THEN 1 ELSE 2 END, n) = 1)"""
SETS_SCOPE = "wide"


def _sets_sql() -> str:
    from .acl_queries import OBJECTS_SQL, SCOPES, gate_sql

    return rf"""WITH vis AS (SELECT doc_id FROM ({OBJECTS_SQL}) WHERE ({gate_sql(SCOPES[SETS_SCOPE])}) = 'ok'), {SETS_SQL}, {TRUST_SQL},
vl AS (SELECT query_id, kind, n, v.vec_id AS doc_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM qk JOIN embeddings q ON q.vec_id = qk.vec JOIN vis ON true JOIN embeddings v ON v.vec_id = vis.doc_id),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind, n ORDER BY score DESC, doc_id) AS rank FROM vl QUALIFY rank <= 20),
kt AS (SELECT DISTINCT query_id, kind, n, unnest({TOK.format('query')}) AS term FROM qk WHERE kind <> 'hyde'),
held AS (SELECT doc_id, unnest(list_distinct({TOK.format("substr(text, 1, 4000)")})) AS term FROM documents JOIN vis USING (doc_id)),
kr AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind, n ORDER BY covered DESC, doc_id) AS rank FROM (SELECT query_id, kind, n, doc_id, count(*) AS covered FROM held JOIN kt USING (term) GROUP BY ALL) QUALIFY rank <= 20),
legs AS (SELECT query_id, doc_id, rank, score, NULL AS kw FROM vr UNION ALL SELECT query_id, doc_id, rank, NULL, rank FROM kr),
m AS (SELECT query_id, doc_id, coalesce(max(score), 0.3) AS score, min(kw) AS kw_rank, round(sum(1 / (60.0 + rank)), 9) AS rrf FROM legs GROUP BY ALL),
sv AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM m) WHERE (score >= 0.3 AND round(top - score, 9) <= 0.05) OR coalesce(kw_rank <= 5, false) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) <= 20),
rr AS (SELECT sv.query_id, doc_id, any_value(text) AS text, max(CASE WHEN len({TOK.format('qk.query')}) = 0 THEN greatest(0, least(1, score)) ELSE 0.7 * len(list_intersect(list_distinct({TOK.format('qk.query')}), list_distinct({TOK.format('text')}))) / len(list_distinct({TOK.format('qk.query')})) + 0.3 * greatest(0, least(1, score)) END) AS s FROM sv JOIN qk ON qk.query_id = sv.query_id AND kind <> 'hyde' JOIN documents USING (doc_id) GROUP BY sv.query_id, doc_id),
r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank, CASE WHEN doc_id % 4 > 0 THEN doc_id % 9 END AS parent FROM (SELECT query_id, doc_id, text, round(s, 9) AS s FROM rr) QUALIFY rank <= 7),
pm AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent ORDER BY rank) AS pn FROM r1 QUALIFY parent IS NULL OR pn <= 2),
pd AS (SELECT query_id, doc_id, text, CASE WHEN parent IS NULL THEN s ELSE round(s * pow(0.85, pn - 1), 9) END AS s FROM pm),
tw AS (SELECT query_id, doc_id, regexp_replace(coalesce(text, ''), '\s+', '', 'g') AS k, round(CASE WHEN reasons <> '' THEN s * (0.85 + 0.15 * trust) ELSE s END, 6) AS s FROM pd JOIN tr_ust USING (doc_id) WHERE trust >= 0.3),
dd AS (SELECT * FROM tw QUALIFY k = '' OR row_number() OVER (PARTITION BY query_id, substr(k, 1, 512) ORDER BY s DESC, doc_id) = 1)
SELECT query_id, doc_id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM dd QUALIFY rank <= 5"""


@query(_sets_sql())
def r6_query_sets(spark, sf):
    """Typed query sets over a scoped corpus. Main and extra queries go to the vector and the
    term leg, hypothetical answers to the vector leg only; hits of keywords alone enter at the floor."""
    from .acl_queries import SCOPES, with_objects

    docs = with_objects(evidence(load(spark, sf, "documents"))).withColumn("parent_id", F.expr("CASE WHEN doc_id % 4 > 0 THEN doc_id % 9 END"))
    vectors = load(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    sets = spark.createDataFrame(SETS, "query_id int, kind string, n int, query string, vec long")
    sets = sets.join(vectors.select(F.col("doc_id").alias("vec"), F.col("embedding").alias("vector")), "vec", "left").drop("vec")
    return Corpus(docs, term_index(spark, sf), vectors).with_scope(SCOPES[SETS_SCOPE]).retrieve(sets, 5)

"""Retrieval as one plan: scope, vector and keyword legs of a query set, fusion, rerank, and what comes after it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import acl as A
from ..functions import text as T
from ..operators import metadata as M
from ..operators import retrieval as R
from ..operators.term_index import TermIndex
from .common import settle

#: Kinds of queries in the order they are taken, the score below which no vector hit counts and that keyword hits enter with, the
#: most candidates that are reranked, and the share of a result that is drawn beyond it.
KINDS = ("main", "extra", "hyde")
FLOOR, CANDIDATES, HEADROOM = 0.30, 20, 2
EVIDENCE = ("is_image", "engine", "confidence", "review", "quality_ok", "ocr_ok", "quality_reasons")


def query_sets(rows: DataFrame) -> DataFrame:
    """rows (query_id, kind, n, query, vector) without empty texts, each text of a query once, as the first kind that asks it; `leg` names
    it among its query's."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    first = F.row_number().over(W.partitionBy("query_id", "query").orderBy(order, "n"))
    kept = rows.where(F.col("kind").isin(*KINDS) & (F.col("query") != "")).withColumn("__n", first).where("__n = 1").drop("__n")
    return kept.withColumn("leg", F.concat_ws(":", "kind", "n"))


@dataclass(frozen=True)
class Corpus:
    """docs: doc_id, text, the object columns where a scope is used, parent_id and the columns of EVIDENCE where `retrieve` is.
    vectors: doc_id, embedding. Without a scope nothing is found unless `open` is set."""

    docs: DataFrame
    index: TermIndex
    vectors: DataFrame | None = None
    scope: A.Scope | None = None
    narrowed: M.Filter | None = None
    open: bool = False

    def with_scope(self, scope: A.Scope) -> Corpus:
        return replace(self, scope=scope)

    def where(self, narrowed: M.Filter) -> Corpus:
        return replace(self, narrowed=narrowed)

    def visible(self) -> DataFrame:
        """The documents the scope and the filter leave, decided before any ranking."""
        rows = self.docs
        if self.scope is not None:
            rows = rows.where(A.allows(self.scope))
        elif not self.open:
            rows = rows.where(F.lit(False))
        return rows if self.narrowed is None else rows.where(self.narrowed.column())

    def _within(self) -> DataFrame | None:
        return None if self.scope is None and self.narrowed is None and self.open else self.visible().select("doc_id")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, doc_id, score, rank: BM25 and term coverage fused, the pool reranked by token coverage, equal texts once."""
        pool, within = max(4 * k, k + 8, CANDIDATES), self._within()
        legs = self.index.bm25(queries, pool, within).select("query_id", "doc_id", "rank").unionByName(self.index.term_rank(queries, pool, within).select("query_id", "doc_id", "rank"))
        fused = R.rrf(legs.withColumn("weight", F.lit(1.0)), ["doc_id"], pool)
        rows = fused.join(self.docs.select("doc_id", "text"), "doc_id").join(queries.select("query_id", "query"), "query_id")
        rows = R.heuristic_rerank(rows.withColumn("score", F.col("rrf") * 30))
        rows = R.keep_first(rows, R.content_key(F.col("text")), ["query_id"], [F.desc("rerank"), F.col("doc_id")])
        return R.ranked(rows.select("query_id", "doc_id", F.round("rerank", 6).alias("score")), ["query_id"], [F.desc("score"), F.col("doc_id")], k)

    def legs(self, sets: DataFrame, pool: int) -> DataFrame:
        """query_id, doc_id, rank, score (null of a keyword leg), kw_rank (null of a vector leg): the first `pool` of each leg."""
        within = self._within()
        ask = F.struct("query_id", "leg")
        words = self.index.term_rank(sets.where("kind <> 'hyde'").select(ask.alias("query_id"), "query"), pool, within)
        out = words.select("query_id.query_id", "doc_id", "rank", F.lit(None).cast("double").alias("score"), F.col("rank").alias("kw_rank"))
        if self.vectors is None:
            return out
        vectors = self.vectors if within is None else self.vectors.join(within, "doc_id", "left_semi")
        near = R.knn(vectors, sets.where("vector IS NOT NULL").select(ask.alias("query_id"), F.col("vector").alias("q")), pool, key="doc_id", but_own=False)
        return out.unionByName(near.select("query_id.query_id", "doc_id", "rank", "score", F.lit(None).cast("int").alias("kw_rank")))

    def retrieve(self, rows: DataFrame, k: int = 5, gap: float = 0.05, per_parent: int = 2, least_trust: float = 0.30) -> DataFrame:
        """query_id, doc_id, score, rank of query sets (see `query_sets`).

        Legs of the scope's documents are fused by rank; a document's score is its best vector score or, if keywords alone found it,
        FLOOR. Candidates near the best score or high in a keyword leg are reranked by the main and extra queries, the best of which
        counts. Half of k is drawn beyond k, since what comes after removes rows: two a parent, repeated parents decayed, doubtful
        evidence lowered or dropped, equal texts once.
        """
        sets = query_sets(rows)
        pool = max(4 * k, k + 8, CANDIDATES)
        legs = self.legs(sets, pool)
        fused = legs.groupBy("query_id", F.col("doc_id").alias("key")).agg(
            F.coalesce(F.max("score"), F.lit(max(FLOOR, 0.30))).alias("score"), F.min("kw_rank").alias("kw_rank"), F.round(F.sum(1 / (R.RRF_K + F.col("rank"))), 9).alias("rrf"),
        ).withColumn("is_graph", F.lit(False)).withColumn("is_figure", F.lit(False))
        # written, at most CANDIDATES rows a query: so Spark knows how few they are and brings them to the documents, whose texts are not dealt
        hits = settle(R.survivors(fused, k, FLOOR, gap, CANDIDATES).select("query_id", F.col("key").alias("doc_id"), F.col("score").alias("prior")))
        hits = settle(hits.join(self.docs.select("doc_id", "text", "parent_id", *EVIDENCE), "doc_id"))
        asked = R.heuristic_rerank(hits.select("query_id", "doc_id", "text", F.col("prior").alias("score")).join(sets.where("kind <> 'hyde'").select("query_id", "query"), "query_id"))
        best = asked.groupBy("query_id", "doc_id").agg(F.round(F.max(_sound(F.col("rerank"))), 9).alias("score"))
        hits = R.ranked(hits.join(best, ["query_id", "doc_id"]), ["query_id"], [F.desc("score"), F.col("doc_id")], min(k + k // HEADROOM, max(k, CANDIDATES)))
        hits = R.parent_decay(R.max_per_parent(hits, per_parent))
        hits = hits.withColumn("trust", T.trust(*(F.col(c) for c in ("text", *EVIDENCE)))).where(F.col("trust.score") >= least_trust)
        hits = hits.withColumn("score", F.round(T.trust_weighted(F.col("score"), F.col("trust")), 6))
        hits = R.keep_first(hits, R.content_key(F.col("text")), ["query_id"], [F.desc("score"), F.col("doc_id")])
        return R.ranked(hits.select("query_id", "doc_id", "score"), ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def _sound(score: Column) -> Column:
    """A score from a reranker: none if it is not a number, else within 0 and 1."""
    return F.when(~F.isnan(score), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))

"""Retrieval: postings, BM25, term coverage, exact vector search, fusion, thresholds, windows over ranked lists."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.batches import slices

K1, B, RRF_K = 1.5, 0.75, 60
_RUN, _HAN = re.compile(r"[a-z0-9]+"), re.compile(r"[\u4e00-\u9fff]+")


def tokens_of(low: str) -> list[str]:
    """`functions.text.tokens` of a text that is in lower case already."""
    out = _RUN.findall(low)
    if not low.isascii():
        for run in _HAN.findall(low):
            out += [run] if len(run) == 1 else map("".join, zip(run, run[1:], strict=False))
    return out


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, doc_len, term, tf: a row per document and distinct term."""
    words = docs.select(key, T.tokens(F.col(text)).alias("words"))
    return (
        words.select(key, F.size("words").alias("doc_len"), F.explode("words").alias("term"))
        .groupBy(key, "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))
    )


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: n_docs and avgdl, documents without a token included."""
    return docs.select(F.size(T.tokens(F.col(text))).alias("l")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("l").alias("avgdl"))


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = 10, key: str = "doc_id") -> DataFrame:
    """query_id, key, score, rank for queries (query_id, query): Okapi BM25 over distinct query terms, best k a query.

    Only postings of asked terms are built: the texts' tokens are filtered by a semi-join on the asked terms before they are
    counted, so what is shuffled is the matching occurrences. Ties go by key.
    """
    asked = queries.select("query_id", F.explode(T.query_terms(F.col("query"), 1 << 30)).alias("term"))
    words = docs.select(key, T.tokens(F.col("text")).alias("words")).withColumn("doc_len", F.size("words"))
    stats = words.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avgdl"))
    hits = words.select(key, "doc_len", F.explode("words").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = hits.groupBy(key, "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = tf.join(df, "term").join(asked, "term").crossJoin(F.broadcast(stats))  # stats: one row
    return bm25_of(scored, F.col("n_docs"), F.col("avgdl"), k, key)


def bm25_of(scored: DataFrame, n_docs: Column, avgdl: Column, k: int | None, key: str = "doc_id") -> DataFrame:
    """The ranking of postings (query_id, key, term, tf, doc_len) with the df of their terms."""
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / avgdl))
    total = scored.groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return ranked(total, ["query_id"], [F.desc("score"), F.col(key)], k)


def term_rank(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """query_id, key, covered, rank: documents whose index terms hold any query term, by how many they hold."""
    asked = queries.select("query_id", F.explode(T.query_terms(F.col("query"))).alias("term"))
    held = docs.select(key, F.explode(T.index_terms(F.col("text"))).alias("term"))
    hits = held.join(asked, "term").groupBy("query_id", key).agg(F.count(F.lit(1)).alias("covered"))
    return ranked(hits, ["query_id"], [F.desc("covered"), F.col(key)], k)


def ranked(rows: DataFrame, by: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """rows with a 1-based rank in each group, the first k of it."""
    out = rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.where(F.col(name) <= k)


#: Scores that a task holds at once: of a block of vectors by as many queries as fit.
MOST_CELLS = 1 << 20


def _best_of_block(queries: np.ndarray, ids: np.ndarray, k: int, kind: str):
    """Batches of (key, vector) to each query's best k rows among them: query_id, key, score."""
    norms = np.sqrt((queries * queries).sum(axis=1)) if kind == "cosine" else None
    sign = -1 if kind in ("cosine", "dot") else 1

    def scores(block: np.ndarray, queries: np.ndarray, norms: np.ndarray | None) -> np.ndarray:
        if kind in ("euclid", "manhattan"):
            apart = (block[:, None, :] - q for q in queries[:, None, :])
            return np.stack([np.sqrt((d * d).sum(axis=2))[:, 0] if kind == "euclid" else np.abs(d).sum(axis=2)[:, 0] for d in apart], axis=1)
        out = block @ queries.T
        with np.errstate(divide="ignore", invalid="ignore"):
            return out / (np.sqrt((block * block).sum(axis=1))[:, None] * norms[None, :]) if kind == "cosine" else out

    def run(batches):
        for batch in batches:
            at = np.flatnonzero(pc.equal(pc.list_value_length(batch.column(1)), queries.shape[1]).fill_null(False).to_numpy(zero_copy_only=False))
            if not len(at):
                continue
            some = batch.take(pa.array(at))
            block = np.asarray(some.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(at), -1)
            keys, order = some.column(0), np.asarray(pc.rank(some.column(0), sort_keys="ascending", tiebreaker="first"))
            step = max(1, MOST_CELLS // len(at))
            for begin in range(0, len(queries), step):
                part = slice(begin, begin + step)
                found = np.floor(scores(block, queries[part], None if norms is None else norms[part]) * 1e6 + 0.5) / 1e6
                of, rows = [], []
                for q in range(found.shape[1]):
                    s = sign * found[:, q]
                    held = np.flatnonzero(np.isfinite(s) & (s <= np.partition(s, k - 1)[k - 1]) if len(s) > k else np.isfinite(s))
                    held = held[np.lexsort((order[held], s[held]))][:k]
                    of.append(np.full(len(held), q))
                    rows.append(held)
                of, rows = np.concatenate(of), np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids[part][of], pa.int64()), keys.take(pa.array(rows)), pa.array(found[rows, of])], names=["query_at", "key", "score"])

    return run


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, kind: str = "cosine", key: str = "vec_id", most_queries: int = 4096, but_own: bool = True) -> DataFrame:
    """query_id, key, score, rank: exact nearest vectors of queries (query_id, q), by score to six places, then key.

    A stated query set against all rows: at most `most_queries` queries at a time go to the tasks as one matrix. Each block of
    vectors is multiplied by it, some queries at a time so that a task holds MOST_CELLS scores or one a vector, keeps its best k a
    query and sends only those on. With but_own a query's own row is left out.
    Null vectors and those of another length than the query's have no score, nor has a zero vector by cosine.
    """
    source = vectors.select(key, F.transform("embedding", lambda x: x.cast("double")).alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    kinds = dict(vectors.dtypes)[key], dict(queries.dtypes)["query_id"]
    asked = queries.where("q IS NOT NULL").select("query_id", F.transform("q", lambda x: x.cast("double")).alias("q"))
    found, parts = None, max(1, -(-asked.count() // most_queries))
    dealt = asked.withColumn("p", F.pmod(F.xxhash64("query_id", "q"), F.lit(parts)))
    for i in range(parts):
        some = dealt.where(F.col("p") == i).collect()  # about most_queries rows
        names = vectors.sparkSession.createDataFrame([(n, r["query_id"]) for n, r in enumerate(some)], f"query_at long, query_id {kinds[1]}")
        for length in sorted({len(r["q"]) for r in some}):
            ids = [n for n, r in enumerate(some) if len(r["q"]) == length]
            matrix = np.array([some[n]["q"] for n in ids], dtype=np.float64).reshape(len(ids), length)
            one = source.mapInArrow(_best_of_block(matrix, np.array(ids), k + but_own, kind), f"query_at long, key {kinds[0]}, score double").join(F.broadcast(names), "query_at")
            found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {kinds[1]}, {key} {kinds[0]}, score double, rank int")
    scored = found.select("query_id", F.col("key").alias(key), "score")
    scored = scored.where(F.col(key) != F.col("query_id")) if but_own else scored
    best = F.desc("score") if kind in ("cosine", "dot") else F.asc("score")
    return ranked(scored, ["query_id"], [best, F.col(key)], k)


def rrf(legs: DataFrame, by: list[str], k: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of rows (query_id, *by, leg, rank 1-based, weight): sum of weight / (60 + rank)."""
    fused = legs.groupBy("query_id", *by).agg(F.round(F.sum(F.col("weight") / (RRF_K + F.col("rank"))), 9).alias("rrf"))
    return ranked(fused, ["query_id"], [F.desc("rrf"), *[F.col(c) for c in by]], k)


def above_threshold(rows: DataFrame, k: int, least: float = 0.30, gap: float = 0.05) -> DataFrame:
    """Rows with score >= least and within `gap` of their query's best, the first k."""
    top = F.max("score").over(W.partitionBy("query_id"))
    kept = rows.withColumn("top", top).where((F.col("score") >= least) & (F.round(F.col("top") - F.col("score"), 9) <= gap)).drop("top")
    return ranked(kept, ["query_id"], [F.desc("score"), F.col("key")], k)


def min_score(rows: DataFrame, least: float, ratio: float = 0.0) -> DataFrame:
    """Rows with score >= least and >= ratio (1 at most) of the head's; a query's head always stays."""
    w = W.partitionBy("query_id").orderBy("rank")
    out = rows.withColumn("head", F.first("score").over(w)).withColumn("n", F.row_number().over(w))
    return out.where(((F.col("score") >= least) & (F.col("score") >= F.col("head") * min(ratio, 1.0))) | (F.col("n") == 1)).drop("head", "n")


def survivors(rows: DataFrame, top_k: int, least: float = 0.30, gap: float = 0.05, most: int = 20) -> DataFrame:
    """Fused rows that the vector score, a keyword rank in the first top_k, a graph path or a figure reference keeps."""
    top = F.max("score").over(W.partitionBy("query_id"))
    near = (F.col("score") >= least) & (F.round(F.col("top") - F.col("score"), 9) <= gap)
    kept = rows.withColumn("top", top).where(near | F.coalesce(F.col("kw_rank") <= top_k, F.lit(False)) | F.col("is_graph") | F.col("is_figure")).drop("top")
    return ranked(kept, ["query_id"], [F.desc("rrf"), F.col("key")], most)


def heuristic_rerank(rows: DataFrame) -> DataFrame:
    """rows (query, text, score) with rerank: 0.7 of token coverage and 0.3 of the clipped score; without tokens the score."""
    q, d = F.array_distinct(T.tokens(F.col("query"))), F.array_distinct(T.tokens(F.col("text")))
    prior = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return rows.withColumn("rerank", F.when(F.size(q) == 0, prior).otherwise(0.7 * F.size(F.array_intersect(q, d)) / F.size(q) + 0.3 * prior))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def max_per_parent(rows: DataFrame, most: int = 2) -> DataFrame:
    """The first `most` rows of each parent in rank order; rows without a parent stay."""
    n = F.row_number().over(W.partitionBy("query_id", "parent_id").orderBy("rank"))
    return rows.withColumn("n", n).where(F.col("parent_id").isNull() | (F.col("n") <= most)).drop("n")


def parent_decay(rows: DataFrame, decay: float = 0.85) -> DataFrame:
    """Each further row of a parent is worth `decay` times the one before; ranks follow the new scores."""
    n = F.row_number().over(W.partitionBy("query_id", "parent_id").orderBy("rank")) - 1
    out = rows.withColumn("score", F.when(F.col("parent_id").isNull(), F.col("score")).otherwise(F.round(F.col("score") * F.pow(F.lit(decay), n), 9)))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "rank")))


def keep_first(rows: DataFrame, key: Column, by: list[str], order: list[Column], blanks: bool = True) -> DataFrame:
    """The first row of each key; with blanks, rows of an empty key all stay."""
    n = F.row_number().over(W.partitionBy(*by, "__key").orderBy(*order))
    out = rows.withColumn("__key", key).withColumn("__n", n)
    return out.where((F.col("__n") == 1) | (F.lit(blanks) & (F.col("__key") == ""))).drop("__key", "__n")


def content_key(text: Column) -> Column:
    """What content dedup compares: the first 512 characters without white space."""
    return F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""), 1, 512)


def merge_graph(rows: DataFrame, limit: int) -> DataFrame:
    """Ordinary rows by rank and graph rows by key: the first limit // 3 graph rows take the last places."""
    graph = ranked(rows.where("is_graph"), ["query_id"], [F.col("key")], limit // 3, "place").withColumn("part", F.lit(1))
    taken = graph.groupBy("query_id").agg(F.count(F.lit(1)).alias("taken"))
    plain = ranked(rows.where("NOT is_graph"), ["query_id"], [F.col("rank"), F.col("key")], None, "place").withColumn("part", F.lit(0))
    plain = plain.join(taken, "query_id", "left").where(F.col("place") <= limit - F.coalesce("taken", F.lit(0))).drop("taken")
    return ranked(plain.unionByName(graph), ["query_id"], [F.col("part"), F.col("place")], None, "final_rank").drop("part", "place")


def _supported(batches):
    """(key, n, hits) of rows (key, low, held, both in lower case): tokens of low, and those of them that held has."""
    for batch in slices(slices(batches), 2):
        n, hits = [], []
        for low, held in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words, have = tokens_of(low), set(tokens_of(held))
            n.append(len(words))
            hits.append(sum(w in have for w in words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hits, pa.int64())], names=[batch.schema.names[0], "n", "hits"])


def support_of(pairs: DataFrame, key: str) -> DataFrame:
    """key, support of pairs (key, text, held): share of text's tokens, as often as they occur, that held has. Each pair is settled where
    it lies, in time linear in its texts; tokens are never dealt."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    counted = pairs.select(key, low("text"), low("held")).mapInArrow(_supported, f"{key} {dict(pairs.dtypes)[key]}, n long, hits long")
    return counted.select(key, F.round(F.when(F.col("n") == 0, 0.0).otherwise(F.col("hits") / F.col("n")), 6).alias("support"))


def hydrated(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """hits (document_id, parent_id, parent_text) with the text of their parent, where they have none, from parents (parent_id,
    document_id, text; distinct). A parent must be of the hit's own document; hits without one stay as they are."""
    p = parents.select("parent_id", "document_id", F.col("text").alias("__text"))
    return hits.join(p, ["parent_id", "document_id"], "left").withColumn("parent_text", F.coalesce("parent_text", "__text")).drop("__text").select(*hits.columns)


def ranking_texts(hits: DataFrame, bridges: DataFrame, most: int = 2, chars: int = 600) -> DataFrame:
    """hits (query_id, document_id, chunk_index, text) with ranking_text: the text after the quotes of its bridges (query_id, document_id,
    chunk_index, at, from_document, from_chunk, quote) whose own chunk is a hit too, of the first `most` bridges, `chars` of each."""
    key = ["query_id", "document_id", "chunk_index"]
    first = bridges.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy("at"))).where(F.col("__n") <= most)
    seen = hits.select("query_id", F.col("document_id").alias("from_document"), F.col("chunk_index").alias("from_chunk")).distinct()
    quotes = first.join(seen, ["query_id", "from_document", "from_chunk"], "left_semi").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.substring("quote", 1, chars).alias("q")))), lambda s: s["q"]).alias("quotes"))
    rows = hits.join(quotes, key, "left")
    return rows.withColumn("ranking_text", F.array_join(F.concat(F.coalesce("quotes", F.array().cast("array<string>")), F.array(F.coalesce("text", F.lit("")))), "\n")).drop("quotes")


def good_enough(queries: DataFrame, hits: DataFrame, least: float = 0.05) -> DataFrame:
    """query_id, good: whether the best score of a query's hits reaches `least`; not so without hits."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce(F.col("best") >= least, F.lit(False)).alias("good"))

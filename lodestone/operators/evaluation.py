"""Retrieval metrics, the evidence gate, aggregation over slices, regression gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def judged(run: DataFrame, gold: DataFrame) -> DataFrame:
    """run (query_id, key, rank) joined with gold (query_id, key, gain): hit, gain, and running counts over the rank."""
    rows = run.join(gold.withColumn("hit", F.lit(1)), ["query_id", "key"], "left").fillna({"hit": 0, "gain": 0.0})
    w = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("hits", F.sum("hit").over(w)).withColumn("seen", F.count(F.lit(1)).over(w))


def metrics(queries: DataFrame, run: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """A row a query: hit, recall, precision and ndcg at each k, rr and ap.

    Without gold: hit 0, all else null. Without results: recall, rr, ap and ndcg 0, precision null. Precision divides by the
    rows returned in the first k; the ideal gains are cut to as many rows.
    """
    rows = judged(run, gold)
    n_gold = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"), F.sort_array(F.collect_list("gain"), asc=False).alias("ideal"))
    per = [F.sum(F.when((F.col("hit") == 1), F.col("hits") / F.col("seen"))).alias("ap_sum"), F.min(F.when(F.col("hit") == 1, F.col("seen"))).alias("first_hit"), F.max("seen").alias("returned")]
    for k in ks:
        per.append(F.sum(F.when((F.col("seen") <= k), F.col("hit"))).alias(f"h{k}"))
        per.append(F.sum(F.when(F.col("seen") <= k, (F.pow(F.lit(2.0), "gain") - 1) / F.log2(F.col("seen") + 1))).alias(f"d{k}"))
    out = queries.select("query_id").join(n_gold, "query_id", "left").join(rows.groupBy("query_id").agg(*per), "query_id", "left")
    has, zero = F.col("n_gold").isNotNull(), F.lit(0.0)
    cols: list[Column] = ["query_id"]
    for k in ks:
        top = F.least(F.coalesce("returned", F.lit(0)), F.lit(k))
        idcg = F.aggregate(
            F.transform(F.slice("ideal", 1, F.when(top > 0, top).otherwise(F.size("ideal"))), lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 2)), F.lit(0.0), lambda s, v: s + v
        )
        h = F.coalesce(F.col(f"h{k}"), F.lit(0))
        cols += [
            F.when(has & (h > 0), 1.0).otherwise(0.0).alias(f"hit_{k}"), F.when(has, F.round(h / F.col("n_gold"), 6)).alias(f"recall_{k}"),
            F.when(has & (top > 0), F.round(h / top, 6)).alias(f"precision_{k}"), F.when(has & (idcg > 0), F.round(F.coalesce(F.col(f"d{k}"), zero) / idcg, 6)).alias(f"ndcg_{k}"),
        ]
    return out.select(*cols, F.when(has, F.round(F.coalesce(1 / F.col("first_hit"), zero), 6)).alias("rr"), F.when(has, F.round(F.coalesce("ap_sum", zero) / F.col("n_gold"), 6)).alias("ap"))


def aggregated(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of each metric over the queries that have it, each value rounded to four places before and after."""
    names = [c for c, t in per_query.dtypes if t == "double"]
    return per_query.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(F.round(c, 4)), 4).alias(c) for c in names])


def citation_scores(rows: DataFrame) -> DataFrame:
    """precision, recall and f1 of arrays `cited` against `supporting`; null where a denominator is 0."""
    tp = F.size(F.array_intersect("cited", "supporting"))
    fp, fn = F.size(F.array_except("cited", "supporting")), F.size(F.array_except("supporting", "cited"))
    p, r = F.when(tp + fp > 0, tp / (tp + fp)), F.when(tp + fn > 0, tp / (tp + fn))
    f1 = F.when(p.isNotNull() & r.isNotNull(), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
    return rows.withColumns({"tp": tp, "fp": fp, "fn": fn, "precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f1, 6)})


def score_profile(run: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, top, weakest, ratio: the best score, that of the weakest gold row found, and their ratio."""
    rows = run.join(gold.select("query_id", "key").withColumn("hit", F.lit(True)), ["query_id", "key"], "left")
    got = rows.groupBy("query_id").agg(F.max("score").alias("top"), F.min(F.when(F.col("hit"), F.col("score"))).alias("weakest"))
    return got.withColumn("ratio", F.when(F.col("top") > 0, F.round(F.col("weakest") / F.col("top"), 6)))


def gates(values: DataFrame, least: dict[str, float]) -> DataFrame:
    """A row per gate: name, value, threshold, passed; a missing value does not pass."""
    pairs = F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).cast("double").alias("value"), F.lit(v).alias("threshold")) for n, v in least.items()])
    return values.select(F.explode(pairs).alias("g")).select("g.*").withColumn("passed", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)))


def evidence_gate(queries: DataFrame, hits: DataFrame, min_chunks: int = 1, min_top: float = 0.25, min_coverage: float = 0.20, min_chars: int = 20) -> DataFrame:
    """A row a query: evidence_count, top_score, coverage, passed, confidence, reason, from hits (query_id, text, score, rank)."""
    held = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("top"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("t")))), lambda s: s["t"]), "\n").alias("evidence")
    )
    rows = queries.join(held, "query_id", "left").fillna({"n": 0, "top": 0.0, "evidence": ""})
    rows = rows.withColumn("cov", F.when(F.col("n") == 0, 0.0).otherwise(T.coverage(F.col("query"), F.col("evidence"))))
    checks = [("has_evidence", F.col("n") >= max(1, min_chunks)), ("top_score", F.col("top") >= min_top), ("query_coverage", F.col("cov") >= min_coverage), ("evidence_length", F.length(F.trim("evidence")) >= min_chars)]
    failed = F.concat_ws(",", *[F.when(~ok, name) for name, ok in checks])
    passed = failed == ""
    confidence = F.when(passed, 0.5 * F.least(F.lit(1.0), F.col("top")) + 0.5 * F.col("cov")).otherwise(0.0)
    why = F.when(F.col("n") == 0, "no_evidence").when(passed, "evidence_sufficient").otherwise(F.concat(F.lit("insufficient_evidence:"), failed))
    return rows.select("query_id", F.col("n").alias("evidence_count"), F.round("top", 4).alias("top_score"), F.round("cov", 4).alias("coverage"), passed.alias("passed"), F.round(confidence, 4).alias("confidence"), why.alias("reason"))

"""Queries of the analytic operators: evaluation, quality statistics, conversations, lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as N
from ..operators import evaluation as E
from ..operators import governance as G
from ..operators import retrieval as R
from .common import load
from .retrieval_queries import KNN_SQL

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def events(spark, sf):
    """Quality events from the event table; a tenth of them without a gate result."""
    return load(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("intent"), F.when(F.col("event_id") % 10 != 0, F.col("event_id") % 3 != 0).alias("passed"),
        (F.col("event_id") % 4).alias("citations"), F.least(F.col("event_id") % 4, F.col("event_id") % 3).alias("supported"), (F.col("event_id") % 7 == 0).alias("changed"), F.col("value").alias("latency"), "event_id", "user_id",
    )


EV = "(SELECT ts, event_type AS intent, CASE WHEN event_id % 10 <> 0 THEN event_id % 3 <> 0 END AS passed, event_id % 4 AS citations, least(event_id % 4, event_id % 3) AS supported, event_id % 7 = 0 AS changed, value AS latency, event_id, user_id FROM events) AS e"
STATS = "count(*) AS total, count(passed) AS gated, count(*) FILTER (passed) AS passed, sum(citations) AS citations, sum(supported) AS supported, count(*) FILTER (changed) AS changed, round(count(*) FILTER (passed) / nullif(count(passed), 0), 4) AS pass_rate, round(sum(supported) / nullif(sum(citations), 0), 4) AS support_rate, round(avg(latency), 4) AS avg_latency, round(max(latency), 4) AS max_latency, round(quantile_cont(latency, 0.95), 4) AS p95_latency"


@query(f"SELECT {STATS} FROM {EV}")
def g1_quality_stats(spark, sf):
    """G1: quality statistics over all events."""
    return N.quality_stats(events(spark, sf))


@query(f"SELECT {STATS} FROM {EV} WHERE ts >= TIMESTAMP '2024-01-23 00:00:00'")
def g1_quality_stats_recent(spark, sf):
    """G1: the same over a look-back window."""
    return N.quality_stats(events(spark, sf), "2024-01-23 00:00:00")


@query(f"SELECT intent, count(*) AS n FROM {EV} GROUP BY intent")
def g1_by_intent(spark, sf):
    """Events by intent."""
    return N.by_intent(events(spark, sf))


@query(f"SELECT CASE WHEN grouping(intent) = 0 THEN 'intent' WHEN grouping(status) = 0 THEN 'status' ELSE 'total' END AS dimension, CASE WHEN grouping(intent) = 0 THEN intent WHEN grouping(status) = 0 THEN status END AS value, count(*) AS n FROM (SELECT intent, concat('s', event_id % 3) AS status FROM {EV}) GROUP BY GROUPING SETS ((), (intent), (status))")
def g2_badcase_counts(spark, sf):
    """Totals and counts by reason and by status in one pass."""
    return N.grouped_counts(events(spark, sf).select("intent", F.concat(F.lit("s"), F.col("event_id") % 3).alias("status")), ["intent", "status"])


@query("SELECT c_nationkey, count(*) AS members, min(c_name) AS first_name FROM customer GROUP BY c_nationkey")
def g4_members(spark, sf):
    """Members by group with the least name."""
    return load(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("members"), F.min("c_name").alias("first_name"))


@query("SELECT id, min(nm) AS name, sum(n) AS members FROM (SELECT c_nationkey AS id, nullif(trim(c_mktsegment), '') AS nm, count(*) AS n FROM customer GROUP BY ALL) GROUP BY id")
def g5_departments(spark, sf):
    """Groups by id and name, then one row an id with its least non-blank name."""
    named = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("id"), F.nullif(F.trim("c_mktsegment"), F.lit("")).alias("nm")).agg(F.count(F.lit(1)).alias("n"))
    return named.groupBy("id").agg(F.min("nm").alias("name"), F.sum("n").alias("members"))


@query("SELECT o_custkey % 10 AS company, count(*) AS documents, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, coalesce(sum(o_custkey), 0) AS chunk_sum FROM orders GROUP BY 1")
def g7_deletion_impact(spark, sf):
    """What deleting a company would touch, by conditional counts in one pass."""
    return load(spark, sf, "orders").groupBy((F.col("o_custkey") % 10).alias("company")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"), F.coalesce(F.sum("o_custkey"), F.lit(0)).alias("chunk_sum")
    )


@query("SELECT conv_id, coalesce(max(turn), 0) + 1 AS next_seq FROM conversations GROUP BY conv_id")
def g9_next_seq(spark, sf):
    """Next sequence number of each log."""
    return N.next_seq(load(spark, sf, "conversations"), "conv_id", "turn")


@query(f"SELECT intent AS stage, count(*) AS n, round(sum(latency), 4) AS total, round(max(latency), 4) AS longest, round(avg(latency), 4) AS mean FROM {EV} GROUP BY intent")
def g10_stage_latency(spark, sf):
    """Counters and latency by stage."""
    return events(spark, sf).groupBy(F.col("intent").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("latency"), 4).alias("total"), F.round(F.max("latency"), 4).alias("longest"), F.round(F.avg("latency"), 4).alias("mean"))


@query(f"SELECT CASE WHEN c >= 0.7 THEN 'high' WHEN c >= 0.4 THEN 'mid' ELSE 'low' END AS bucket, count(*) AS n FROM (SELECT (event_id % 101) / 100.0 AS c FROM {EV}) GROUP BY 1")
def g12_confidence(spark, sf):
    """Evidence confidence by bucket."""
    return events(spark, sf).groupBy(N.confidence_bucket((F.col("event_id") % 101) / 100.0).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT intent, count(*) AS n, round(avg(latency), 4) AS mean, quantile_disc(latency, 0.95) AS p95, round(sum(supported) / nullif(sum(citations), 0), 4) AS micro FROM {EV} GROUP BY intent")
def g15_eval_by_category(spark, sf):
    """Mean, nearest-rank p95 and micro citation rate by category."""
    e = events(spark, sf)
    micro = e.groupBy("intent").agg(F.round(F.avg("latency"), 4).alias("mean"), N.ratio(F.sum("supported"), F.sum("citations")).alias("micro"))
    return N.nearest_rank(e, ["intent"], "latency", (0.95,)).join(micro, "intent").select("intent", "n", "mean", "p95", "micro")


@query(f"SELECT user_id % 5 AS worker, count(*) AS n, quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95, quantile_disc(latency, 0.99) AS p99 FROM {EV} GROUP BY 1")
def g16_load_percentiles(spark, sf):
    """Nearest-rank percentiles of latency."""
    return N.nearest_rank(events(spark, sf).withColumn("worker", F.col("user_id") % 5), ["worker"], "latency", (0.5, 0.95, 0.99))


@query(f"SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM {EV}) WHERE n = 1")
def w1_latest_request(spark, sf):
    """Latest request of each applicant."""
    return N.latest_per(events(spark, sf), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM conversations) WHERE after < 2")
def w9_recent_rounds(spark, sf):
    """Turns of each conversation's last two rounds."""
    return N.recent_rounds(load(spark, sf, "conversations"), 2).select("conv_id", "turn", "role")


@query("WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id FROM p WHERE n <= 7 OR len(list_filter(range(7), lambda k: round_even(k * ((n - 1) / 6.0), 0) = i)) > 0")
def w10_spread_sample(spark, sf):
    """Seven documents a source, evenly spread with both ends."""
    return N.spread(load(spark, sf, "documents"), "source", "doc_id", 7).select("source", "doc_id")


@query("SELECT conv_id, CASE WHEN length(t) > 40 THEN substr(t, 1, 40) || '…' ELSE t END AS title, n AS message_count, last_turn FROM (SELECT conv_id, arg_min(text, CASE WHEN role = 'user' THEN turn END) AS t, count(*) AS n, max(turn) AS last_turn FROM conversations GROUP BY conv_id)")
def w12_conversation_list(spark, sf):
    """Conversations with their titles and counts."""
    return N.conversation_list(load(spark, sf, "conversations"))


@query("SELECT a.conv_id, a.turn AS answer_turn, sha256(u.text) AS question_sha, sha256(a.text) AS answer_sha FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user' WHERE a.role = 'assistant'")
def j7_feedback_pairs(spark, sf):
    """Answers with the question before them."""
    return N.answered_pairs(load(spark, sf, "conversations")).select("conv_id", "answer_turn", F.sha2("question", 256).alias("question_sha"), F.sha2("answer", 256).alias("answer_sha"))


@query("SELECT l_orderkey, l_linenumber, c_name, n_name, r_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j9_enrichments(spark, sf):
    """List rows with four left-joined lookups; Spark broadcasts the ones that are small."""
    rows = load(spark, sf, "lineitem")
    rows = rows.join(load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", "c_name", "n_name", "r_name")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j4_valid_documents(spark, sf):
    """Candidates among valid documents, a left-semi join."""
    return load(spark, sf, "documents").select("doc_id").join(load(spark, sf, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j14_missing_points(spark, sf):
    """Documents not embedded yet, a left-anti join on the id."""
    return load(spark, sf, "documents").select("doc_id").join(load(spark, sf, "labels"), "doc_id", "left_anti")


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.q AS before, b.q AS after, a.doc_id IS NULL OR b.doc_id IS NULL AS unpaired FROM (SELECT doc_id, quality AS q FROM labels WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id, toxic AS q FROM labels WHERE doc_id % 4 <> 0) b ON a.doc_id = b.doc_id")
def j13_paired_reports(spark, sf):
    """Two reports paired by case, with cases in only one of them marked."""
    lab = load(spark, sf, "labels")
    a = lab.where("doc_id % 3 <> 0").select("doc_id", F.col("quality").alias("before"))
    b = lab.where("doc_id % 4 <> 0").select("doc_id", F.col("toxic").alias("after"))
    a, b = a.withColumn("x", F.lit(1)), b.withColumn("y", F.lit(1))
    return a.join(b, "doc_id", "full").select("doc_id", "before", "after", (F.col("x").isNull() | F.col("y").isNull()).alias("unpaired"))


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, (SELECT greatest(1, ceil(count(*) / 20.0)::INT) FROM orders) AS pages FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def t4_page(spark, sf):
    """Third page of twenty, newest first."""
    return N.page(load(spark, sf, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 3, 20).select("o_orderkey", "total", "pages")


@query("WITH w AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS in_window FROM events) SELECT event_id, in_window, in_window <= 3 AS allowed FROM w")
def st_rate_limit(spark, sf):
    """Rate limiter: three events a user in any 24 hours."""
    return N.rate_limited(events(spark, sf), "user_id", "ts", 3, 86_400).select("event_id", "in_window", "allowed")


@query("SELECT document_id, count(*) AS n FROM (SELECT CASE WHEN doc_id % 11 <> 0 THEN doc_id % 90 END AS document_id FROM documents) p WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id FROM labels WHERE doc_id < 60) l WHERE l.doc_id = p.document_id) GROUP BY document_id")
def q2_orphans(spark, sf):
    """Points whose document is gone, by document."""
    points = load(spark, sf, "documents").select(F.when(F.col("doc_id") % 11 != 0, F.col("doc_id") % 90).alias("document_id"))
    return G.orphans(points, load(spark, sf, "labels").where("doc_id < 60").select(F.col("doc_id").alias("document_id")))


@query("SELECT n_nationkey, n_name, coalesce(members, 0) AS members, row_number() OVER (ORDER BY coalesce(members, 0) DESC, n_nationkey) AS place FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS members FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def q7_companies(spark, sf):
    """Q7: registry of companies with member counts, largest first (a registry is small: one sort)."""
    n = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("members"))
    rows = load(spark, sf, "nation").join(n, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("members", F.lit(0)).alias("members"))
    return R.ranked(rows.withColumn("all", F.lit(1)), ["all"], [F.desc("members"), F.col("n_nationkey")], None, "place").drop("all")


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS projects FROM events GROUP BY user_id")
def q9_memberships(spark, sf):
    """Q9: valid memberships as one set a user."""
    return load(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("projects"))


def _run(spark, sf):
    """Ten nearest vectors of each fiftieth one as a run; gold: the vectors of its label, gain 1, or 2 for every tenth."""
    v = load(spark, sf, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    run = R.knn(v, q.select("query_id", "q")).select("query_id", F.col("vec_id").alias("key"), "score", "rank")
    gold = v.select(F.col("vec_id").alias("key"), "label").join(q.where("query_id % 200 <> 150").select("query_id", "label"), "label").where("key <> query_id AND key % 3 = 0")
    return q.select("query_id", "label"), run, gold.select("query_id", "key", F.when(F.col("key") % 10 == 0, 2.0).otherwise(1.0).alias("gain"))


EVAL_SQL = f"""{KNN_SQL}, q AS (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 50 = 0),
gold AS (SELECT query_id, e.vec_id AS key, CASE WHEN e.vec_id % 10 = 0 THEN 2.0 ELSE 1.0 END AS gain FROM embeddings e JOIN q USING (label) WHERE e.vec_id <> query_id AND e.vec_id % 3 = 0 AND query_id % 200 <> 150),
g AS (SELECT query_id, count(*) AS n_gold, list(gain ORDER BY gain DESC) AS ideal FROM gold GROUP BY query_id),
r AS (SELECT kr.query_id, kr.vec_id AS key, score, rank, gold.key IS NOT NULL AS hit, coalesce(gain, 0) AS gain FROM kr LEFT JOIN gold ON gold.query_id = kr.query_id AND gold.key = kr.vec_id WHERE rank <= 10),
c AS (SELECT *, sum(hit::INT) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM r),
m AS (SELECT q.query_id, any_value(label) AS label, any_value(n_gold) AS n_gold, any_value(ideal) AS ideal, sum(CASE WHEN hit THEN hits / rank END) AS aps, min(CASE WHEN hit THEN rank END) AS fh, count(c.rank) AS ret,
  {', '.join(f"coalesce(sum(CASE WHEN rank <= {k} THEN hit::INT END), 0) AS h{k}, coalesce(sum(CASE WHEN rank <= {k} THEN (pow(2, gain) - 1) / log2(rank + 1) END), 0) AS d{k}" for k in (1, 3, 5, 10))}
  FROM q LEFT JOIN g USING (query_id) LEFT JOIN c USING (query_id) GROUP BY q.query_id),
e AS (SELECT query_id, label, {', '.join(f"CASE WHEN n_gold IS NOT NULL AND h{k} > 0 THEN 1.0 ELSE 0.0 END AS hit_{k}, CASE WHEN n_gold IS NOT NULL THEN round(h{k} / n_gold, 6) END AS recall_{k}, CASE WHEN n_gold IS NOT NULL AND least(ret, {k}) > 0 THEN round(h{k} / least(ret, {k}), 6) END AS precision_{k}, CASE WHEN n_gold IS NOT NULL THEN round(d{k} / list_sum(list_transform(range(1, least(len(ideal), least(ret, {k})) + 1), lambda i: (pow(2, ideal[i]) - 1) / log2(i + 1))), 6) END AS ndcg_{k}" for k in (1, 3, 5, 10))},
  CASE WHEN n_gold IS NOT NULL THEN round(coalesce(1.0 / fh, 0), 6) END AS rr, CASE WHEN n_gold IS NOT NULL THEN round(coalesce(aps, 0) / n_gold, 6) END AS ap FROM m)"""
_NAMES = [f"{m}_{k}" for k in (1, 3, 5, 10) for m in ("hit", "recall", "precision", "ndcg")] + ["rr", "ap"]


@query(f"WITH {EVAL_SQL} SELECT query_id, {', '.join(_NAMES)} FROM e")
def e1_metrics(spark, sf):
    """Per query hit, recall, precision, nDCG, reciprocal rank and average precision."""
    q, run, gold = _run(spark, sf)
    return E.metrics(q, run, gold)


@query(f"WITH {EVAL_SQL} SELECT label % 3 AS slice, count(*) AS n_queries, {', '.join(f'round(avg(round({n}, 4)), 4) AS {n}' for n in _NAMES)} FROM e GROUP BY 1")
def e9_aggregate(spark, sf):
    """Metric means by slice, rounded before and after."""
    q, run, gold = _run(spark, sf)
    rows = E.metrics(q, run, gold).join(q.select("query_id", (F.col("label") % 3).alias("slice")), "query_id")
    return E.aggregated(rows, ["slice"])


@query(f"WITH {EVAL_SQL} SELECT query_id, max(score) AS top, min(CASE WHEN hit THEN score END) AS weakest, CASE WHEN max(score) > 0 THEN round(min(CASE WHEN hit THEN score END) / max(score), 6) END AS ratio FROM r GROUP BY query_id")
def e8_score_profile(spark, sf):
    """How far the weakest gold row found lies below the best score."""
    _, run, gold = _run(spark, sf)
    return E.score_profile(run, gold)


@query(f"WITH {EVAL_SQL}, a AS (SELECT round(avg(round(recall_10, 4)), 4) AS recall_10, round(avg(round(rr, 4)), 4) AS rr, round(avg(round(precision_3, 4)), 4) AS precision_3 FROM e) SELECT gate, value, threshold, coalesce(value >= threshold, false) AS passed FROM (SELECT 'recall_10' AS gate, recall_10 AS value, 0.9 AS threshold FROM a UNION ALL SELECT 'rr', rr, 0.01 FROM a UNION ALL SELECT 'precision_3', precision_3, 0.75 FROM a)")
def e10_gates(spark, sf):
    """Regression gates over the mean metrics."""
    q, run, gold = _run(spark, sf)
    return E.gates(E.aggregated(E.metrics(q, run, gold)), {"recall_10": 0.9, "rr": 0.01, "precision_3": 0.75})


@query("WITH c AS (SELECT doc_id, list_distinct([doc_id % 4, doc_id % 6, doc_id % 9]) AS cited, CASE WHEN doc_id % 5 = 0 THEN [] ELSE list_distinct([doc_id % 3, doc_id % 7]) END AS sup FROM documents), t AS (SELECT *, len(list_intersect(cited, sup)) AS tp FROM c), u AS (SELECT doc_id, tp, len(cited) - tp AS fp, len(sup) - tp AS fn FROM t) SELECT doc_id, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall, CASE WHEN tp + fn > 0 THEN round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END, 6) END AS f1 FROM u")
def e7_citations(spark, sf):
    """Citation precision, recall and F1 over cited and supporting sets derived from doc_id."""
    d = F.col("doc_id")
    rows = load(spark, sf, "documents").select("doc_id", F.array_distinct(F.array(d % 4, d % 6, d % 9)).alias("cited"), F.when(d % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.array(d % 3, d % 7))).alias("supporting"))
    return E.citation_scores(rows).drop("cited", "supporting")

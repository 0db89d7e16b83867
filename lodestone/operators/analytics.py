"""Operational analytics: quality statistics, list pages, counts, percentiles, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, places: int = 4) -> Column:
    """part / whole rounded, null where whole is 0."""
    return F.when(whole > 0, F.round(part / whole, places))


def quality_stats(events: DataFrame, since: str | None = None) -> DataFrame:
    """One row over events (ts, intent, passed, citations, supported, changed, latency): counts, ratios, mean, maximum and p95."""
    rows = events if since is None else events.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    gated = F.count("passed")
    return rows.agg(
        F.count(F.lit(1)).alias("total"), gated.alias("gated"), F.count_if(F.col("passed")).alias("passed"), F.sum("citations").alias("citations"), F.sum("supported").alias("supported"),
        F.count_if(F.col("changed")).alias("changed"), ratio(F.count_if(F.col("passed")), gated).alias("pass_rate"), ratio(F.sum("supported"), F.sum("citations")).alias("support_rate"),
        F.round(F.avg("latency"), 4).alias("avg_latency"), F.round(F.max("latency"), 4).alias("max_latency"), F.round(F.percentile("latency", 0.95), 4).alias("p95_latency"),
    )


def by_intent(events: DataFrame) -> DataFrame:
    return events.groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


def grouped_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, value, n for each column on its own, and the total under dimension 'total'; one pass by grouping sets."""
    sets = ", ".join(["()", *[f"({c})" for c in columns]])
    rows.createOrReplaceTempView("__counted")
    dims = " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in columns)
    value = " ".join(f"WHEN grouping({c}) = 0 THEN {c}" for c in columns)
    return rows.sparkSession.sql(f"SELECT CASE {dims} ELSE 'total' END AS dimension, CASE {value} END AS value, count(*) AS n FROM __counted GROUP BY GROUPING SETS ({sets})")


def nearest_rank(values: DataFrame, by: list[str], column: str, ps: tuple[float, ...]) -> DataFrame:
    """sorted[ceil(p * n) - 1] of each group for each p, as p50 and so on."""
    return values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").alias(f"p{round(p * 100)}") for p in ps])


def confidence_bucket(c: Column) -> Column:
    return F.when(c >= 0.7, "high").when(c >= 0.4, "mid").otherwise("low")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) with total and pages (1 at least) beside each row."""
    total = rows.count()
    out = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return out.withColumn("total", F.lit(total)).withColumn("pages", F.lit(max(1, -(-total // size))))


def latest_per(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where("__n = 1").drop("__n")


def conversation_list(turns: DataFrame, title_chars: int = 40) -> DataFrame:
    """conv_id, title (first user message, cut with an ellipsis), message_count, last_turn."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    rows = turns.groupBy("conv_id").agg(first.alias("t"), F.count(F.lit(1)).alias("message_count"), F.max("turn").alias("last_turn"))
    cut = F.when(F.length("t") > title_chars, F.concat(F.substring("t", 1, title_chars), F.lit("…"))).otherwise(F.col("t"))
    return rows.select("conv_id", cut.alias("title"), "message_count", "last_turn")


def recent_rounds(turns: DataFrame, rounds: int) -> DataFrame:
    """Turns of each conversation's last `rounds` rounds; a round starts at a user message."""
    w = W.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, -1)
    after = F.coalesce(F.sum((F.col("role") == "user").cast("int")).over(w), F.lit(0))
    return turns.withColumn("__after", after).where(F.col("__after") < rounds).drop("__after")


def answered_pairs(turns: DataFrame) -> DataFrame:
    """Assistant turns with the user turn before them."""
    a = turns.where("role = 'assistant'").select("conv_id", F.col("turn").alias("answer_turn"), F.col("text").alias("answer"))
    u = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("answer_turn"), F.col("text").alias("question"))
    return a.join(u, ["conv_id", "answer_turn"])


def spread(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """About `most` rows of each group, evenly spread with the first and the last: places round(i * (n - 1) / (most - 1)), half
    to even."""
    w = W.partitionBy(by)
    placed = rows.withColumn("__i", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    step = (F.col("__n") - 1) / F.lit(float(max(1, most - 1)))
    wanted = F.when(F.col("__n") <= most, F.lit(True)).otherwise(F.exists(F.sequence(F.lit(0), F.lit(max(1, most) - 1)), lambda i: F.bround(i * step) == F.col("__i")))
    return placed.where(wanted).drop("__i", "__n")


def next_seq(events: DataFrame, by: str, seq: str) -> DataFrame:
    return events.groupBy(by).agg((F.coalesce(F.max(seq), F.lit(0)) + 1).alias("next_seq"))


def rate_limited(events: DataFrame, by: str, ts: str, limit: int, seconds: int) -> DataFrame:
    """events with in_window (the key's events in the last `seconds`, itself included) and allowed (at most limit)."""
    w = W.partitionBy(by).orderBy(F.unix_micros(F.col(ts))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count(F.lit(1)).over(w)).withColumn("allowed", F.col("in_window") <= limit)

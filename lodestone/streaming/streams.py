"""Structured Streaming: event windows with late data, idempotent submits, incremental term index, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.term_index import TermIndex

STATES = ["pending", "parsing", "chunking", "embedding", "completed"]


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Events from Parquet files as they arrive; ts as a timestamp, which watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_quality(events: DataFrame, width: str = "24 hours", slide: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, intent, n, passed, latency over sliding windows; events later than the watermark are left out."""
    w = F.window("ts", width, slide)
    return (
        events.withWatermark("ts", late).groupBy(w.alias("w"), F.col("event_type").alias("intent"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 0).alias("passed"), F.round(F.avg("value"), 8).alias("latency")).select(F.col("w.start").alias("start"), "intent", "n", "passed", "latency")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s.alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def submitted_once(requests: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first request of each key within the watermark."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def rate_limited(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """user_id, event_id, allowed: at most `limit` allowed events a user in any `seconds`; the state is the allowed times of that
    span, in event order within a batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for ts, event in zip(rows["ts"], rows["event_id"], strict=True):
            now = ts.timestamp()
            held = [t for t in held if t > now - seconds]
            if ok := len(held) < limit:
                held.append(now)
            out.append((key[0], event, ok))
        state.update((held,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, allowed boolean", "held array<double>", "append", "NoTimeout")


def index_terms(docs: DataFrame, target: str, checkpoint: str):
    """A query that keeps a term table at `target`: each batch's documents go to the folders of a hash of their ids, which are
    rewritten whole, so a replayed batch changes nothing."""

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select("doc_id", F.array_join(X.index_terms(F.col("text")), " ").alias("terms"), F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("part")).where("terms <> ''").dropDuplicates(["doc_id"])
        parts = [r["part"] for r in batch.select(F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("part")).distinct().collect()]  # 16 at most
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(target)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            old = spark.read.parquet(target).where(F.col("part").isin(parts)).join(batch.select("doc_id").distinct(), "doc_id", "left_anti")
            staged = f"{target.rstrip('/')}-staged/{epoch}"
            old.unionByName(fresh.withColumn("part", F.col("part").cast("int"))).write.mode("overwrite").parquet(staged)
            fresh = spark.read.parquet(staged)
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(target)

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def next_state(state, failed):
    """The state after a step: the next of STATES, failed where the step failed; completed and failed stay."""
    from pyspark.sql import Column

    assert isinstance(state, Column)
    out = state
    for a, b in zip(STATES, STATES[1:], strict=False):
        out = F.when(state == a, b).otherwise(out)
    return F.when(state.isin("completed", "failed"), state).when(failed, "failed").otherwise(out)


class EventLog:
    """Ordered logs in a folder of Parquet files: log, seq (from 1 without gaps in each log), at, payload."""

    SCHEMA = "log string, seq long, at timestamp, payload string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def rows(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder)

    def append(self, events: DataFrame) -> None:
        """Numbers events (log, at, payload) after what their logs hold, by time, then payload. One writer at a time."""
        last = self.rows().groupBy("log").agg(F.max("seq").alias("last"))
        n = F.row_number().over(W.partitionBy("log").orderBy("at", "payload"))
        new = events.withColumn("n", n).join(last, "log", "left").select("log", (F.coalesce("last", F.lit(0)) + F.col("n")).alias("seq"), "at", "payload")
        new.write.mode("append").parquet(self.folder)

    def after(self, cursors: DataFrame) -> DataFrame:
        """What each reader has not seen: rows of the logs of cursors (reader, log, after_seq; null: nothing seen) beyond them."""
        asked = cursors.select("reader", "log", F.coalesce("after_seq", F.lit(0)).alias("after_seq"))
        return self.rows().join(asked, "log").where("seq > after_seq").select("reader", "log", "seq", "at", "payload")

    def advanced(self, cursors: DataFrame, seen: DataFrame) -> DataFrame:
        """cursors moved to the last rows seen (reader, log, seq); they never go back."""
        last = seen.groupBy("reader", "log").agg(F.max("seq").alias("seen"))
        return cursors.join(last, ["reader", "log"], "left").select("reader", "log", F.greatest("after_seq", "seen").alias("after_seq"))

    def stream(self, after: int = 0) -> DataFrame:
        """The log as a stream, rows up to `after` left out; the checkpoint of the query that reads it is its cursor from then on."""
        return self.spark.readStream.schema(self.SCHEMA).parquet(self.folder).where(F.col("seq") > after)


def interrupted(documents: DataFrame) -> DataFrame:
    """documents (state, error) as a restart leaves them: what was being worked on has failed and says so, so that it is submitted again;
    what waits or has ended stays."""
    cut = F.col("state").isin(STATES[1:-1])
    return documents.withColumn("error", F.when(cut, F.concat(F.lit("interrupted while "), "state")).otherwise(F.col("error"))).withColumn("state", F.when(cut, "failed").otherwise(F.col("state")))


def index_revisions(docs: DataFrame, index: str, revisions: str, checkpoint: str, parts: int = 16):
    """A query that keeps a stored term index of docs (doc_id, text) as revisions of them arrive.

    A revision is known by the hash of its text: documents whose hash is the one on record are passed over, others are replaced in the
    index, and their hashes are recorded, in the folders of a hash of their ids, only once the index holds them. A query that stops
    between the two replaces the same documents by the same texts when its batch comes again.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        latest = batch.where("doc_id IS NOT NULL").withColumn("n", F.monotonically_increasing_id()).groupBy("doc_id").agg(F.max(F.struct("n", F.coalesce("text", F.lit("")).alias("text"))).alias("l"))
        new = latest.select("doc_id", "l.text", F.sha2("l.text", 256).alias("revision"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part")).persist()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(revisions)
            there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
            held = [r["part"] for r in new.select("part").distinct().collect()]  # `parts` rows at most
            known = spark.read.parquet(revisions).where(F.col("part").isin(held)).select("doc_id", "revision", "part") if there else new.select("doc_id", "revision", "part").limit(0)
            changed = new.join(known, ["doc_id", "revision"], "left_anti")
            if not TermIndex.exists(spark, index):
                TermIndex.build(changed.limit(0).select("doc_id", "text"), index)
            if changed.isEmpty():
                return
            TermIndex(spark, index).replace(changed.select("doc_id", "text"))
            kept = known.join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(changed.select("doc_id", "revision", "part"))
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(revisions)
        finally:
            new.unpersist()

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)

import time

from lodestone.streaming import streams as K

DATA = "/root/testdata/sf0.001"


def test_windows_equal_batch(spark, tmp_path):
    schema = spark.read.parquet(f"{DATA}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{DATA}/events.parquet").orderBy("ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / "x"))
    stream = K.windowed_quality(K.event_stream(spark, str(tmp_path / "in" / "x"), schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    want = K.windowed_quality(spark.read.parquet(f"{DATA}/events.parquet").selectExpr("event_id", "cast(ts AS timestamp) AS ts", "event_type", "value"))
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, want.collect()))


def test_rate_limit_and_index(spark, tmp_path):
    rows = [(1, i, f"2024-01-01 00:00:{i:02d}") for i in range(5)] + [(2, 9, "2024-01-01 00:00:00"), (1, 20, "2024-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "user_id long, event_id long, t string").selectExpr("user_id", "event_id", "cast(t AS timestamp) AS ts")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    q = K.rate_limited(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")), 3, 60).writeStream.outputMode("append").format("memory").queryName("limited").start()
    q.processAllAvailable()
    q.stop()
    assert {r["event_id"] for r in spark.table("limited").where("allowed").collect()} == {0, 1, 2, 9, 20}
    docs = spark.createDataFrame([(1, "a b a"), (2, "c")], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    target = str(tmp_path / "terms")
    for _ in range(2):
        source = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "d"))
        q = K.index_terms(source, target, str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()
        spark.createDataFrame([(1, "new words")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
        time.sleep(0.1)
    assert {r["doc_id"]: r["terms"] for r in spark.read.parquet(target).collect()} == {1: "new words", 2: "c"}


def test_log_and_cursors(spark, tmp_path):
    log = K.EventLog(spark, str(tmp_path / "log"))
    events = lambda *rows: spark.createDataFrame(rows, "log string, t string, payload string").selectExpr("log", "cast(t AS timestamp) AS at", "payload")
    log.append(events(("a", "2024-01-01 00:00:02", "second"), ("a", "2024-01-01 00:00:01", "first"), ("b", "2024-01-01", "x")))
    log.append(events(("a", "2023-01-01", "third"), ("c", "2024-01-01", "y")))
    assert sorted((r["log"], r["seq"], r["payload"]) for r in log.rows().collect()) == [("a", 1, "first"), ("a", 2, "second"), ("a", 3, "third"), ("b", 1, "x"), ("c", 1, "y")]
    cursors = spark.createDataFrame([("r1", "a", 2), ("r2", "a", None), ("r1", "b", 1)], "reader string, log string, after_seq long")
    seen = log.after(cursors)
    assert sorted((r["reader"], r["log"], r["seq"]) for r in seen.collect()) == [("r1", "a", 3), ("r2", "a", 1), ("r2", "a", 2), ("r2", "a", 3)]
    moved = log.advanced(cursors, seen)
    assert sorted((r["reader"], r["log"], r["after_seq"]) for r in moved.collect()) == [("r1", "a", 3), ("r1", "b", 1), ("r2", "a", 3)] and log.after(moved).isEmpty()

    def read():
        q = log.stream(after=1).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).start(str(tmp_path / "out"))
        q.processAllAvailable()
        q.stop()
        return sorted((r["log"], r["seq"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert read() == [("a", 2), ("a", 3)]
    log.append(events(("b", "2025-01-01", "later")))  # while no query runs
    assert read() == [("a", 2), ("a", 3), ("b", 2)]


def test_restart_marks_interrupted_work(spark):
    rows = spark.createDataFrame([(i, s, None) for i, s in enumerate([*K.STATES, "failed"])], "id int, state string, error string")
    assert [(r["state"], r["error"]) for r in K.interrupted(rows).orderBy("id").collect()] == [
        ("pending", None), ("failed", "interrupted while parsing"), ("failed", "interrupted while chunking"), ("failed", "interrupted while embedding"), ("completed", None), ("failed", None),
    ]


def test_index_of_revisions_survives_a_stop(spark, tmp_path, monkeypatch):
    from lodestone.operators.term_index import TermIndex

    source, paths = str(tmp_path / "in"), [str(tmp_path / p) for p in ("index", "revisions", "ck")]

    def arrive(*rows):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)

    def run():
        q = K.index_revisions(spark.readStream.schema("doc_id long, text string").parquet(source), *paths).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    held = lambda: sorted((r["doc_id"], r["term"]) for r in TermIndex(spark, paths[0]).all().collect())
    arrive((1, "alpha beta"), (2, "gamma"), (None, "lost"))
    run()
    assert held() == [(1, "alpha"), (1, "beta"), (2, "gamma")]
    generations = len(TermIndex(spark, paths[0]).totals())
    arrive((1, "alpha beta"))  # an unchanged revision
    run()
    assert len(TermIndex(spark, paths[0]).totals()) == generations
    arrive((2, "delta"), (3, "alpha"))
    real = TermIndex.replace

    def stops(self, docs):
        real(self, docs)
        raise RuntimeError("stopped before the hashes were recorded")

    with monkeypatch.context() as m:
        m.setattr(TermIndex, "replace", stops)
        try:
            run()
        except Exception:
            pass
    run()
    assert held() == [(1, "alpha"), (1, "beta"), (2, "delta"), (3, "alpha")] and TermIndex(spark, paths[0]).size()[0] == 3
    assert spark.read.parquet(paths[1]).count() == 3

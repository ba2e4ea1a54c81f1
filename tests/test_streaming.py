from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spanloom.streaming import live as L

START = datetime(2026, 1, 1)
SCHEMA = "trace_id string, span_id string, received_at timestamp, error boolean"


def feed(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame([(t, s, START + timedelta(minutes=m), e) for t, s, m, e in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b*")


def drain(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_copies_once(spark, tmp_path):
    s = feed(spark, tmp_path, [[("AA", "1", 0, False), ("aa", "2", 1, False)], [("a-a", "1 ", 30, False), ("bb", "1", 31, True)]])
    assert sorted((r.trace_id, r.span_id) for r in drain(L.once(s), "once", tmp_path)) == [("aa", "1"), ("aa", "2"), ("bb", "1")]


def test_windows_drop_what_is_too_late(spark, tmp_path):
    s = feed(spark, tmp_path, [[("a", "1", 5, False), ("a", "2", 10, False)], [("a", "3", 200, False)], [("a", "3", 201, False)], [("a", "4", 6, False), ("a", "5", 400, False)]])
    got = {(r.start - START, r.n) for r in drain(L.windowed(s, "received_at", "trace_id"), "win", tmp_path)}
    assert got == {(timedelta(0), 2), (timedelta(hours=3), 2)}


def test_sessions(spark, tmp_path):
    s = feed(spark, tmp_path, [[("a", "1", 0, False), ("a", "2", 60, False)], [("a", "3", 1200, False)], [("b", "1", 4000, False)]])
    got = {(r.trace_id, (r.start - START).seconds // 60, r.n) for r in drain(L.sessions(s, "received_at", "trace_id"), "ses", tmp_path)}
    assert got == {("a", 0, 2), ("a", 1200, 1)}


def test_traces_close_once_and_late_spans_show(spark, tmp_path):
    s = feed(spark, tmp_path, [[("a", "1", 0, True), ("a", "2", 5, False)], [("b", "1", 100, False)], [("b", "2", 101, False)], [("a", "3", 95, False), ("c", "1", 101, False)], [("c", "2", 102, False)]])
    rows = drain(L.closed_traces(s), "closed", tmp_path)
    a = [(r.spans, r.errors, r.late) for r in rows if r.trace_id == "a"]
    assert a == [(2, 1, 0), (3, 1, 1)]
    assert F  # the module needs a session

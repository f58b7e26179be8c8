import json

from pyspark.sql import functions as F

from skein.functions import speech as V
from skein.streaming import voice


def test_sessions_and_control(spark, tmp_path):
    rows = [("wake", "s", 0.0), ("speech", "s", 5.0), ("mute", "s", 6.0), ("speech", "s", 100.0), ("speech", "t", 3.0)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"kind": k, "session_id": s, "text": "", "meta": {}, "ts": t}) for k, s, t in rows))
    events = voice.read_events(spark, str(tmp_path / "in"))
    q = voice.session_counts(events, "15 seconds", "1 hour").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.session_id, r.n_events) for r in spark.table("counts").collect()) == [("s", 1), ("s", 3), ("t", 1)]
    batch = spark.createDataFrame(rows, "kind string, session_id string, ts double")
    assert [tuple(r) for r in voice.control_state(batch).collect()] == [("s", True)]


def test_wake_word_machine(spark, tmp_path):
    said = [("open it", 0), ("hey computer, lights on", 10), ("and music", 15), ("stop", 18), ("ignored", 20), ("hey computer", 30), ("late", 60)]
    spark.createDataFrame([(1, t, s) for t, s in said], "stream_id long, text string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    out = voice.active_sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "hey computer", ("stop",))
    q = out.writeStream.format("memory").queryName("machine").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.kind, r.text) for r in spark.table("machine").collect()] == [("wake", "lights on"), ("query", "and music"), ("stop", "stop"), ("wake", ""), ("timeout", "")]


def test_bridge_goes_on_after_errors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("hello\nstop\n\nbad\n")
    seen = []

    def answer(rows):
        return rows.withColumn("display", F.when(F.col("text") == "bad", F.raise_error(F.lit("no"))).otherwise(F.upper("text")))

    bridge = voice.Bridge(answer, [lambda df, n: seen.extend(df.select("text", "error").collect())], skip=lambda t: V.skip_text(t, ("stop",)))
    bridge.start(voice.read_lines(spark, str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.text for r in seen) == ["bad", "hello"] and all(r.error for r in seen)
    good = voice.Bridge(lambda rows: rows.withColumn("display", F.upper("text")), [voice.text_sink(str(tmp_path / "out")), voice.json_sink(str(tmp_path / "json"))])
    good.start(voice.read_lines(spark, str(tmp_path / "in")), str(tmp_path / "cp2")).awaitTermination()
    assert "HELLO" in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")) and spark.read.json(str(tmp_path / "json")).count() == 3


def test_appended_lines():
    assert voice.appended_lines("a\nb\n", "a\nb\nc\n") == ["c"]
    assert voice.appended_lines("a\nb\n", "a\nx\n") == ["x"] and voice.appended_lines("a\n", "") == []

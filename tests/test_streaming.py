"""The event log as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.streaming import events


def test_drain_counts_and_lines(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 3}:00:00", "parse" if i % 2 else "render", "m", "DEBUG" if i == 5 else "INFO", 0.5) for i in range(6)]
    df = spark.createDataFrame(rows, "event_id long, ts string, stage string, message string, level string, progress double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "log"))
    stream = events.visible(events.read(spark, str(tmp_path / "log"), df.schema))
    seen = []
    q = events.drain(stream, lambda b, n: seen.extend(r.event_id for r in b.collect()), str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    assert sorted(seen) == [0, 1, 2, 3, 4]
    assert df.select(events.progress_line(F.col("stage"), F.col("message"), F.col("progress"))).first()[0] == "[render] [ 50%] m"
    counts = events.stage_counts(events.read(spark, str(tmp_path / "log"), df.schema))
    q = counts.writeStream.outputMode("append").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def test_progress_reaches_every_listener(spark, tmp_path, caplog):
    progress, table, seen = events.Progress(), events.TableListener(), []

    def broken(e):
        raise RuntimeError("no")

    for listener in (broken, seen.append, table, events.log_listener()):
        progress.attach(listener)
    progress.attach(table)  # not twice
    with caplog.at_level("DEBUG"):
        progress.emit("parse", "one", progress=0.5)
        progress.emit("render", "two", "DEBUG")
    progress.detach(broken)
    progress.detach(broken)
    progress.emit("write", "three", "ERROR")
    assert [e["message"] for e in seen] == ["one", "two", "three"] and [e["event_id"] for e in seen] == [0, 1, 2]
    assert "[parse] one" in caplog.text and "a listener failed" in caplog.text
    table.write(spark, str(tmp_path / "log"))
    got = spark.read.parquet(str(tmp_path / "log"))
    assert sorted(r.message for r in events.visible(got).collect()) == ["one", "three"] and got.count() == 3
    try:
        progress.emit("x", "y", "LOUD")
    except ValueError:
        return
    raise AssertionError("an unknown level must not pass")

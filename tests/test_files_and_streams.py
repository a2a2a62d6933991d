"""Files, session logs, change sets and the streaming forms."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from termloom.operators import activity, glossary
from termloom.sources import files
from termloom.streaming import events

SF = "/root/testdata/sf0.001"


def test_signatures(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "b.xlsx").write_bytes(b"PK\x03\x04zip")
    (tmp_path / "c.pdf").write_bytes(b"PK\x03\x04zip")
    (tmp_path / "d.csv").write_bytes(b"x,y")
    (tmp_path / "e.exe").write_bytes(b"MZ")
    df = files.binary(spark, str(tmp_path)).select(F.regexp_extract("path", r"([a-e])\.", 1).alias("f"), files.signature(F.col("content"), F.col("path")).alias("kind"))
    assert {r.f: r.kind for r in df.collect()} == {"a": "pdf", "b": "xlsx", "c": None, "d": "csv", "e": None}


def test_sections(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n\n\ntwo\fthree\n\n ")
    assert [r.text.strip() for r in files.documents(files.binary(spark, str(tmp_path))).orderBy("section").collect()] == ["one", "two", "three"]


def test_session_logs_round_trip(spark, tmp_path):
    rows = [("s1", "deck", 0, 0, "a", "b"), ("s1", "deck", 0, 1, "c", "d"), ("s1", "deck", 3, 0, "e", "f"), ("s2", "book", 0, 0, "data:image/png", "x"), ("s2", "book", 0, 1, "g", "h")]
    df = spark.createDataFrame(rows, "session_id string, file_name string, slide_index int, pos int, source string, target string")
    files.write_sessions(df, str(tmp_path / "out"))
    got = sorted((r.session_id, r.slide_index, r.source, r.target) for r in files.sessions(spark, str(tmp_path / "out"), lines=True).collect())
    assert got == [("s1", 0, "a", "b"), ("s1", 0, "c", "d"), ("s1", 3, "e", "f"), ("s2", 0, "g", "h")]
    (tmp_path / "one").mkdir()
    (tmp_path / "one/log.json").write_text(json.dumps({"session_id": "x", "slides": [{"slide_index": 1, "pairs": [{"id": "p", "source": "s", "target": "t"}]}]}, indent=1))
    assert [tuple(r)[2:] for r in files.sessions(spark, str(tmp_path / "one")).collect()] == [(1, 0, "s", "t")]


def test_changes_make_the_new_table(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    after = spark.createDataFrame([(1, "a"), (2, "x"), (4, "n")], "k long, v string")
    changes = glossary.changes(before, after, "k")
    assert sorted(tuple(r) for r in files.apply_changes(before, changes, after, "k").collect()) == [(1, "a"), (2, "x"), (4, "n")]


def test_header_roles(spark):
    df = spark.createDataFrame([("s", 0, "Viet"), ("s", 1, "English"), ("t", 0, "foo"), ("t", 1, "bar"), ("t", 2, "z")], "sheet string, col int, text string")
    assert {(r.sheet, r.col): r.role for r in files.header_roles(df, "sheet").collect()} == {("s", 0): "target", ("s", 1): "source", ("t", 0): "source", ("t", 1): "target", ("t", 2): None}


def test_text_runs(spark):
    xml = '<p:sp><a:t>One</a:t><a:t xml:space="preserve"> two</a:t></p:sp>'
    assert spark.createDataFrame([(xml,)], "x string").select(files.text_runs(F.col("x"))).first()[0] == ["One", " two"]


def drained(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


@pytest.fixture(scope="module")
def batch(spark):
    return spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("operation"), "value")


def test_stream_quota_equals_batch(spark, batch):
    got = {(r.user_id, r.day.strftime("%Y-%m-%d"), r.used) for r in drained(events.daily_quota(events.read(spark, SF), 5), "quota", "complete").collect()}
    assert got == {(r.user_id, r.day, r.used) for r in activity.daily_quota(batch, "user_id", 5).collect()}


def test_stream_counters_equal_batch(spark, batch):
    got = {(r.event_type, r.n) for r in drained(events.counters(events.read(spark, SF)), "counters", "complete").collect()}
    assert got == {(r.operation, r["count"]) for r in batch.groupBy("operation").count().collect()}


def test_stream_sessions_hold_every_event(spark, batch):
    rows = drained(events.sessions(events.read(spark, SF)), "sessions", "complete").collect()
    assert sum(r.n for r in rows) == batch.count()


def test_sliding_windows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(i, start + dt.timedelta(seconds=10 * i), 1, "x", 1.0, "{}") for i in range(6)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "in"))
    out = drained(events.sliding_counts(events.read(spark, str(tmp_path / "in"), "*.parquet", 99), "60 seconds", "30 seconds"), "sliding", "complete")
    assert {(r.start, r.n) for r in out.collect()} == {(start - dt.timedelta(seconds=30), 3), (start, 6), (start + dt.timedelta(seconds=30), 3)}


def test_ring_buffer_over_several_batches(spark, tmp_path, batch):
    src = str(tmp_path / "in")
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(src)
    q = events.ring_buffer(events.read(spark, src, "*.parquet"), str(tmp_path / "ring"), 20, str(tmp_path / "ckpt")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.event_id for r in spark.read.parquet(str(tmp_path / "ring/0")).collect()}
    assert got == {r.id for r in batch.orderBy(F.desc("ts"), F.desc("id")).limit(20).collect()}

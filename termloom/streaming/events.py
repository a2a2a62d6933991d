"""Streaming forms of the log operators: quotas, sliding counts, sessions, ring buffer, circuit breaker.

The bounded forms are in ``termloom.operators.activity``. Watermarks bound all state; the windowed forms
are native aggregations, the breaker keeps one small row of state per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, pattern: str = "events.parquet", files: int = 1) -> DataFrame:
    """The events of a folder as a stream, with a watermark."""
    rows = spark.readStream.schema(EVENT).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


def daily_quota(events: DataFrame, limit: int) -> DataFrame:
    """ST02: per user and UTC day, used and exhaustion."""
    g = events.groupBy("user_id", F.window("ts", "1 day").alias("day")).agg(F.count("*").alias("used"))
    return g.select("user_id", F.col("day.start").alias("day"), "used", (F.col("used") >= limit).alias("exhausted"))


def sliding_counts(events: DataFrame, length: str = "60 seconds", step: str = "10 seconds") -> DataFrame:
    """ST01: counts by sliding window and user."""
    return events.groupBy(F.window("ts", length, step).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Not in the reference: sessions of a user that end with a gap."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def counters(events: DataFrame) -> DataFrame:
    """ST05: running counts by type, for complete output."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def ring_buffer(events: DataFrame, path: str, keep: int, checkpoint: str):
    """ST06, SNK13: the newest events as a table, rewritten with each batch; both of its versions are ``keep`` rows long."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("event_id", "ts", "event_type")
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{path}/{(number - 1) % 2}"))
        newest = rows.dropDuplicates(["event_id"]).orderBy(F.desc("ts"), F.desc("event_id")).limit(keep)
        newest.write.mode("overwrite").parquet(f"{path}/{number % 2}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


class Breaker(StatefulProcessor):
    """ST03: per key closed, open and half open over event time; state: failures in a row and the end of the opening."""

    def __init__(self, failures: int, open_seconds: int):
        self.failures, self.open_seconds = failures, open_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "bad int, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bad, until = (int(x) for x in self.state.get()) if self.state.exists() else (0, 0)
        table = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for event, t, ok in zip(table["event_id"], table["ts"].astype("datetime64[us]").astype("int64"), table["ok"]):
            if until and t < until:
                out.append((event, "OPEN"))
                continue
            half = bool(until)
            out.append((event, "HALF_OPEN" if half else "CLOSED"))
            if ok:
                bad, until = 0, 0
            else:
                bad += 1
                if half or bad >= self.failures:
                    until = int(t) + self.open_seconds * 1_000_000
        self.state.update((bad, until))
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "event_id": [e for e, _ in out], "state": [s for _, s in out]})

    def close(self) -> None:
        pass


def breaker(events: DataFrame, failures: int, open_seconds: int) -> DataFrame:
    rows = events.select("user_id", "event_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return rows.groupBy("user_id").transformWithStateInPandas(Breaker(failures, open_seconds), "user_id long, event_id long, state string", "Append", "None")

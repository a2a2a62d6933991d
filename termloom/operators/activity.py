"""Logs: sliding counts, admission, quotas, breakers, ring buffers - on bounded tables; streaming forms are in ``termloom.streaming``."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding_count(log: DataFrame, key: str, seconds: int) -> DataFrame:
    """W08, ST01: for each event the events of its key in the window that ends with it, both ends included."""
    micros = F.unix_micros("ts")
    frame = Window.partitionBy(key).orderBy("micros").rangeBetween(-seconds * 1_000_000, 0)
    return log.withColumn("micros", micros).withColumn("n", F.count("*").over(frame)).drop("micros")


def admitted(log: DataFrame, key: str, limit: int, seconds: int) -> DataFrame:
    """W09, ST04: events with whether they pass a limit per window; only admitted ones count, the window excludes its start.

    Admission is recursive, so a key's events are read in order, as a stream: state is at most ``limit`` times.
    """
    schema = f"{key} long, id long, ok boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, times = object(), deque()
        for b in batches:
            ok = []
            for k, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if k != current:
                    current, times = k, deque()
                while times and t - times[0] >= seconds * 1_000_000:
                    times.popleft()
                ok.append(len(times) < limit)
                if ok[-1]:
                    times.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], [key, "id", "ok"])

    rows = log.select(F.col(key).cast("long").alias(key), F.col("id").cast("long").alias("id"), F.unix_micros("ts").alias("t"))
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key, "t", "id").mapInArrow(run, schema)


def breaker(log: DataFrame, key: str, failures: int, open_seconds: int) -> DataFrame:
    """ST03: the state each event (ok: Boolean) meets: closed, open (refused), half open; after ``failures`` in a row it opens."""
    schema = f"{key} long, id long, state string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bad, until = object(), 0, None
        for b in batches:
            out = []
            for k, t, ok in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if k != current:
                    current, bad, until = k, 0, None
                if until is not None and t < until:
                    out.append("OPEN")
                    continue
                state = "CLOSED" if until is None else "HALF_OPEN"
                out.append(state)
                if ok:
                    bad, until = 0, None
                else:
                    bad += 1
                    if state == "HALF_OPEN" or bad >= failures:
                        until = t + open_seconds * 1_000_000
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], [key, "id", "state"])

    rows = log.select(F.col(key).cast("long").alias(key), F.col("id").cast("long").alias("id"), F.unix_micros("ts").alias("t"), "ok")
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key, "t", "id").mapInArrow(run, schema)


def daily_quota(log: DataFrame, key: str, limit: int) -> DataFrame:
    """ST02, A23: per key and UTC day used, left, per cent left (halves up) and exhaustion."""
    g = log.groupBy(key, F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("used"))
    left = F.greatest(F.lit(0), limit - F.col("used"))
    return g.withColumns({"left": left, "percent": F.floor(100 * left / limit + 0.5).cast("int"), "exhausted": F.col("used") >= limit})


def newest(rows: DataFrame, n: int, order: list[Column], keys: list[str] | None = None) -> DataFrame:
    """W12, SNK13, DML09: the newest n rows, of all or of each key; the global form is a top-k, not a sort."""
    if not keys:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("r") <= n).drop("r")


def latest(rows: DataFrame, key: str, time: list[str]) -> DataFrame:
    """ST07: of each key the latest request's row."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*time)).alias("x")).select(key, "x.*")


def zones(log: DataFrame, key: str, kind: str) -> DataFrame:
    """Runs of one kind in order of time: first, last and length."""
    order = Window.partitionBy(key).orderBy("ts", "id")
    rows = log.withColumn("zone", F.sum(F.when(F.lag(kind).over(order) == F.col(kind), 0).otherwise(1)).over(order))
    return rows.groupBy(key, "zone", kind).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def seen_so_far(log: DataFrame, key: str, flag: Column) -> DataFrame:
    """Whether the flag was set by an earlier row of the key, and whether the row stands behind the last one set."""
    order = Window.partitionBy(key).orderBy("ts", "id")
    rows = log.withColumn("flag", flag).withColumn("at", F.row_number().over(order))
    before = F.coalesce(F.max(F.col("flag").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    last = F.coalesce(F.max(F.when(F.col("flag"), F.col("at"))).over(Window.partitionBy(key)), F.lit(0))
    return rows.withColumns({"seen": before, "after_last": F.col("at") > last})


def batches(items: DataFrame, order: list[str], size: int = 25, late_size: int = 15, late_share: float = 0.7) -> DataFrame:
    """ST09: work items dealt in order into batches, smaller ones once late_share of them is done.

    Ranks come from counts by partition, so no window gathers the whole table.
    """
    total = items.count()
    early = -(-int(total * late_share) // size) * size
    ranked = global_rank(items, order)
    r = F.col("rank")
    return ranked.withColumn("batch", F.when(r < early, F.floor(r / size)).otherwise(early // size + F.floor((r - early) / late_size)))


def global_rank(rows: DataFrame, order: list[str]) -> DataFrame:
    """rank from 0 over all rows: range-partitioned sort, then counts of the partitions before.

    Which partition a row is in must not change between the two uses, so it is checkpointed: ``spark.checkpoint.dir`` has to be set.
    """
    if not rows.sparkSession.conf.get("spark.checkpoint.dir", None) and rows.sparkSession.sparkContext.getCheckpointDir() is None:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    dealt = dealt.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    dealt = dealt.checkpoint()
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_at")).drop("_part", "_at", "_id", "_before")

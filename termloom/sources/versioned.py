"""DML06, P04: keyed tables that several writers change from what they read, kept as Parquet by buckets of the key.

A version is a small pointer file that names a folder for each bucket. A commit merges edits into the buckets that they
touch, writes those to a new folder, and then creates the next pointer; only one writer can create it. A writer that comes
too late merges again over the version that won, so of two edits of one key from the same base exactly one is applied and
the other is refused. A writer that dies leaves a folder that no pointer names. The file system must create files
exclusively (HDFS and local ones do); pointers hold ``BUCKETS`` paths at most.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def merge(current: DataFrame, edits: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key, values, version, outcome) of all keys of either side; outcome: 'kept', 'inserted', 'updated', 'refused'.

    current: key, values, version; edits: key, values, base (the version that the writer read, null for a new key), rank. Of
    several edits of a key the one of least rank counts, the others are as if they had not been made. An edit is refused if the
    key's version is no longer its base, or the key has gone; the row stays as it is, and is there only if it was."""
    order = F.struct("rank", *values)
    one = edits.groupBy(*key).agg(F.min_by(F.struct("base", *values), order).alias("e"))
    both = current.select(*key, F.struct("version", *values).alias("c")).join(one, key, "full")
    there, new = F.col("c").isNotNull(), F.col("e").isNotNull()
    fits = F.when(there, F.col("c.version").eqNullSafe(F.col("e.base"))).otherwise(F.col("e.base").isNull())
    outcome = F.when(~new, "kept").when(~fits, "refused").when(there, "updated").otherwise("inserted")
    pick = lambda v: F.when(F.col("outcome").isin("updated", "inserted"), F.col(f"e.{v}")).otherwise(F.col(f"c.{v}")).alias(v)
    version = F.when(F.col("outcome") == "updated", F.col("c.version") + 1).when(F.col("outcome") == "inserted", 1).otherwise(F.col("c.version")).cast("long").alias("version")
    return both.withColumn("outcome", outcome).select(*key, *map(pick, values), version, "outcome")


def revalidated(units: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, text, outcome) of requests (id, made_for, suggestion, rank): the suggestion where the unit's text still is what it was
    made for, else the text as it is; outcome: 'applied', 'stale', 'gone', and 'same' where nothing would change. Of several requests
    of one unit the one of least rank counts."""
    one = requests.groupBy("id").agg(F.min_by(F.struct("made_for", "suggestion"), F.struct("rank", "suggestion")).alias("q"))
    rows = one.join(units.select("id", "text"), "id", "left")
    outcome = F.when(F.col("text").isNull(), "gone").when(F.col("text") != F.col("q.made_for"), "stale").when(F.col("q.suggestion").isNull() | (F.col("text") == F.col("q.suggestion")), "same").otherwise("applied")
    return rows.select("id", "text", "q", outcome.alias("outcome")).select("id", F.when(F.col("outcome") == "applied", F.col("q.suggestion")).otherwise(F.col("text")).alias("text"), "outcome")


class Versioned:
    """A table in a folder: ``read``, ``commit``; key columns, value columns with their types."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], schema: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema + ", version long").schema
        self.values = [f.name for f in self.schema.fields if f.name not in (*key, "version")]

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _there(self, folder: str) -> bool:
        fs, path = self._path(folder[len(self.folder) + 1 :])
        return fs.exists(path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def latest(self) -> tuple[int, dict[str, str]]:
        """The number of the last version and its folders by bucket; (0, {}) before the first."""
        fs, path = self._path("versions")
        names = sorted((f.getPath().getName() for f in fs.listStatus(path) if f.getLen()), reverse=True) if fs.exists(path) else []
        if not names:
            return 0, {}
        text = self.spark.read.text(f"{self.folder}/versions/{names[0]}", wholetext=True).first()[0]
        return int(names[0]), json.loads(text)

    def read(self, version: tuple[int, dict[str, str]] | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the last one), or of some of its buckets."""
        folders = (version or self.latest())[1]
        paths = sorted(p for b, p in folders.items() if buckets is None or int(b) in buckets)
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return rows.where("version is not null")  # an edit refused for want of a row leaves none

    def _publish(self, number: int, folders: dict[str, str]) -> bool:
        """Creates the pointer of a version, unless another writer has."""
        fs, path = self._path("versions", f"{number:012d}")
        try:
            out = fs.create(path, False)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        return True

    def commit(self, edits: DataFrame, seen: tuple[int, dict[str, str]] | None = None) -> DataFrame:
        """Merges edits (key, values, base, rank) and returns (key, outcome) of each edited key. seen: the version to begin with, if it
        is still the last; a version that came between is merged over."""
        edits = edits.select(*self.key, *self.values, "base", "rank")
        touched = [r[0] for r in edits.select(self._bucket().alias("b")).distinct().collect()]  # as many as there are buckets
        if not touched:
            return edits.select(*self.key, F.lit("kept").alias("outcome"))
        now = seen or self.latest()
        while True:
            number, folders = now
            merged = merge(self.read(now, touched), edits, self.key, self.values).withColumn("bucket", self._bucket())
            staged = f"{self.folder}/data/{uuid.uuid4().hex}"
            merged.repartition("bucket").write.partitionBy("bucket").parquet(staged)
            fresh = {str(b): f"{staged}/bucket={b}" for b in touched if self._there(f"{staged}/bucket={b}")}
            if self._publish(number + 1, folders | fresh):
                return self.spark.read.parquet(staged).where("outcome <> 'kept'").select(*self.key, "outcome")
            now = self.latest()

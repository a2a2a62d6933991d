"""Merges that check versions: outcomes, two writers from one base, buckets left alone."""

import threading

import pytest
from termloom.sources.versioned import Versioned, merge, revalidated

EDIT = "k string, v string, base long, rank long"


def test_outcomes(spark):
    current = spark.createDataFrame([("a", "1", 1), ("b", "2", 5), ("c", "3", 2), ("n", None, 1)], "k string, v string, version long")
    edits = spark.createDataFrame([("a", "A", 1, 0), ("b", "B", 4, 0), ("d", "D", None, 0), ("e", "E", 3, 0), ("c", "late", 2, 9), ("c", "first", 2, 1), ("n", None, 1, 0), ("b2", None, None, 0)], EDIT)
    got = {r.k: (r.v, r.version, r.outcome) for r in merge(current, edits, ["k"], ["v"]).collect()}
    assert got == {"a": ("A", 2, "updated"), "b": ("2", 5, "refused"), "c": ("first", 3, "updated"), "d": ("D", 1, "inserted"), "e": (None, None, "refused"), "n": (None, 2, "updated"), "b2": (None, 1, "inserted")}


def test_revalidation(spark):
    units = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (4, "four")], "id long, text string")
    requests = spark.createDataFrame([(1, "one", "ONE", 0), (1, "one", "other", 1), (2, "deux", "TWO", 0), (3, "three", "three", 0), (4, "four", None, 0), (9, "x", "y", 0)], "id long, made_for string, suggestion string, rank int")
    assert sorted(map(tuple, revalidated(units, requests).collect())) == [(1, "ONE", "applied"), (2, "two", "stale"), (3, "three", "same"), (4, "four", "same"), (9, None, "gone")]


def rows(table):
    return sorted((r.k, r.v, r.version) for r in table.read().collect())


@pytest.fixture
def table(spark, tmp_path):
    out = Versioned(spark, f"file://{tmp_path}/t", ["k"], "k string, v string", buckets=4)
    out.commit(spark.createDataFrame([(x, x, None, 0) for x in "abcdefgh"], EDIT))
    return out


def test_two_writers_from_one_base(spark, table):
    assert rows(table) == [(x, x, 1) for x in "abcdefgh"]
    seen = table.latest()  # both read this version
    one = table.commit(spark.createDataFrame([("a", "one", 1, 0), ("b", "one", 1, 0), ("x", "one", None, 0)], EDIT), seen)
    two = table.commit(spark.createDataFrame([("a", "two", 1, 0), ("c", "two", 1, 0), ("x", "two", None, 0), ("q", "none", 3, 0)], EDIT), seen)
    assert sorted(map(tuple, one.collect())) == [("a", "updated"), ("b", "updated"), ("x", "inserted")]
    assert sorted(map(tuple, two.collect())) == [("a", "refused"), ("c", "updated"), ("q", "refused"), ("x", "refused")]
    assert [r for r in rows(table) if r[2] > 1 or r[0] == "x"] == [("a", "one", 2), ("b", "one", 2), ("c", "two", 2), ("x", "one", 1)]
    assert sorted((r.k, r.v) for r in table.read(seen).collect()) == [(x, x) for x in "abcdefgh"]  # the version that was read stays


def test_writers_at_the_same_time(spark, table):
    """Exactly one of four writers wins each key."""
    won, seen = [], table.latest()

    def write(name):
        got = table.commit(spark.createDataFrame([(k, name, 1, 0) for k in "abcdef"], EDIT), seen)
        won.extend((r.k, name) for r in got.where("outcome = 'updated'").collect())

    threads = [threading.Thread(target=write, args=(f"w{i}",)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(k for k, _ in won) == list("abcdef")
    assert {(k, v) for k, v, n in rows(table) if n == 2} == set(won)


def test_only_touched_buckets_are_written(spark, table):
    before = table.latest()[1]
    table.commit(spark.createDataFrame([("a", "new", 1, 0)], EDIT))
    after = table.latest()[1]
    assert sum(before[b] != after[b] for b in before) == 1 and len(rows(table)) == 8
    number = table.latest()[0]
    assert table.commit(spark.createDataFrame([], EDIT)).collect() == [] and table.latest()[0] == number

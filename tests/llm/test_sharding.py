from collections import Counter

import pytest
from termloom.llm import queries, sharding

from .cases import AWKWARD, documents


def brute(shards, slots):
    """Whole preference lists, then turns."""
    lists = []
    for s in shards:
        offset, step = sharding.preference(s, slots)
        lists.append([(offset + j * step) % slots for j in range(slots)])
    table = {}
    while len(table) < slots:
        for k, wish in enumerate(lists):
            if len(table) < slots:
                table[next(x for x in wish if x not in table)] = k
    return [table[i] for i in range(slots)]


def test_table():
    for shards, slots in ((["a"], 2), (["a", "b", "c"], 7), ([f"s{i}" for i in range(11)], 101), ([f"s{i}" for i in range(13)], 13)):
        assert sharding.lookup_table(shards, slots) == brute(shards, slots)


def test_even_loads_and_few_moves():
    before = sharding.lookup_table(queries.SHARDS)
    loads = Counter(before)
    assert max(loads.values()) - min(loads.values()) <= 1
    after = sharding.lookup_table(queries.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(before, after) if a != 47)
    assert moved < 0.1 * len(before)


def test_place(spark):
    df = documents(spark, AWKWARD, extra=True).selectExpr("*", "'mine' as slot", "'mine' as shard", "1 as _slot")
    out = sharding.place(df, "doc_id", ["x\ty", "b", "c"], 13)
    rows = out.collect()
    assert len(rows) == len(AWKWARD) and set(out.columns) == set(df.columns)
    table = sharding.lookup_table(["x\ty", "b", "c"], 13)
    assert all(r.shard == ["x\ty", "b", "c"][table[r["slot"]]] for r in rows)
    assert len({r["slot"] for r in rows if r.doc_id == 7}) == 1
    assert sharding.place(df.limit(0), "doc_id", ["a"], 2).collect() == []


def test_bad_parameters():
    for shards, slots in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, slots)

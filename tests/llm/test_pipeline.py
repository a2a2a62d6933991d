import corpus_pipeline as P
import pytest
from termloom.llm import secrets
from termloom.llm.decontamination import words as _  # noqa: F401

from .cases import documents
from .test_jaccard import shingle_set


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small folder of documents and benchmark with one case for each stage."""
    passage = " ".join(f"bench{i}" for i in range(30))
    base = " ".join(f"the word{i} of" for i in range(40))
    texts = [(1, base), (2, base + " end"), (3, "other text about things " + passage), (4, "clean words stand here alone today"), (5, "12 34 !!"), (6, None), (7, "use password = hunter2hunter2 for this page now"), (8, "clean words stand here alone today"), (9, "x " * 9000)]
    folder = str(tmp_path_factory.mktemp("sf"))
    df = documents(spark, texts).selectExpr("doc_id", "text", "case when doc_id in (1, 4, 7) then 'en' end as lang", "source", "n_chars")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in out.collect()}
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert set(kept["language"]) == {1, 2, 3, 4, 7, 8, 9}
    assert set(kept["near_duplicates"]) == {1, 3, 4, 7, 9}
    assert set(kept["decontaminate"]) == {1, 4, 7, 9}
    assert kept["redact"][7] == "use [REDACTED] for this page now" and kept["redact"][4] == "clean words stand here alone today"
    rows = P.STAGES[-1][1](spark, docs, tables).collect()
    assert {r.doc_id for r in rows} == {1, 4, 7, 9} and max(r.piece for r in rows) == 2


def test_whole_run_on_the_tables(spark):
    """run() against plain Python: what is left holds no near copies and no secrets, and every clean document is there."""
    sf = "/root/testdata/sf0.001"
    out = P.run(spark, sf).collect()
    kept = {r.doc_id for r in out}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    from .test_decontamination import brute

    sets = {i: shingle_set(t) for i, t in docs.items()}
    groups = {i: i for i in docs}
    for a in docs:
        for b in docs:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and groups[a] != groups[b]:
                low, high = sorted((groups[a], groups[b]))
                groups = {i: low if g == high else g for i, g in groups.items()}
    letters = {i for i, t in docs.items() if any(c.isalpha() for c in t or "")}
    first = {i for i in letters if groups[i] == i}
    dirty = {x[0] for x in brute([(i, docs[i]) for i in first], list(enumerate(items))) if x[5]}
    assert kept == first - dirty
    assert secrets.RULES


def test_empty(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _name, stage in P.STAGES:
        assert stage(spark, docs, tables).collect() == []

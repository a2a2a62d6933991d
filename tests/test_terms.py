import pytest
from pyspark.sql import functions as F
from termloom.functions import terms as X


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c"))).first()[0]


@pytest.mark.parametrize(("term", "expected"), [("flashing/edge/material edge", "material edge"), ("vamp (ưu tiên)/toe", "vamp"), ("stitches/inch", "stitches/inch"), ("nail hole (sd cho định vị)", "nail hole"), ("run off stitching", "run-off stitching"), ("Nosew film", "No-sew film"), ("gap/split", "gap")])
def test_clean_target(spark, term, expected):
    assert one(spark, X.clean_target, term) == expected


@pytest.mark.parametrize(("text", "expected"), [("9-10 mũi/inch", "SPI 9-10 stitches/inch"), ("10-12 SPI", "SPI 10-12 stitches/inch"), ("SPI: 10-12 stitches/inch", "SPI 10-12 stitches/inch"), ("SPI 9-10", "SPI 9-10 stitches/inch"), ("lại 2-3 mũi", "lại 2-3 mũi"), ("8 mũi/inch", "SPI 8 stitches/inch"), ("11-12 9-10 SPI", "SPI 11-12 stitches/inch"), ("10 stiches per inch", "SPI 10 stitches/inch"), ("spi check", "SPI check")])
def test_stitch_density(spark, text, expected):
    assert one(spark, X.stitch_density, text) == expected


def test_order_and_hyphens(spark):
    assert one(spark, X.reordered, "1. Shape toe and shape HEEL") == "1. Toe shape and Heel shape"
    assert one(spark, X.hyphenated, "Tipquarter, tip  quarter, NOSEW") == "Tip-quarter, tip-quarter, NO-SEW"


@pytest.mark.parametrize(("text", "expected"), [("FD0736-001", True), ("LQ-075W-1", True), ("Model A", True), ("Nike Air Max 90", True), ("Color migration", False), ("no-sew", False), ("Mẫu giày: SB-077", True), ("", False)])
def test_model_names(spark, text, expected):
    assert one(spark, X.is_model_name, text) is expected


def test_split_bilingual(spark):
    from termloom.plans.sop_queries import SPLITS

    df = spark.createDataFrame([*SPLITS, (None, True, None, None), ("", True, None, None), ("Toe capped\n" * 4000, False, None, None)], "text string, item boolean, en string, vi string")
    for r in df.withColumn("p", X.split_bilingual(F.col("text"), F.col("item"))).collect():
        assert (r.p and (r.p.en, r.p.vi)) == (r.en and (r.en, r.vi)), r


def test_unique_names(spark):
    long = "n" * 40
    rows = spark.createDataFrame([(["a", "A", "a 1", "a", long, long, ""],), ([],), (None,)], "x array<string>").select(X.unique_names(F.col("x"), " EN").alias("u")).collect()
    assert rows[0].u == ["a EN", "A 1 EN", "a 1 1 EN", "a 2 EN", "n" * 28 + " EN", "n" * 26 + " 1 EN", " EN"] and rows[1].u == rows[2].u == []


def test_spelling(spark):
    assert one(spark, lambda c: X.spelling(c, ["kiểm tra", "an toàn"]), "Kiem tra an toan, kiểm tra, kiemtrax") == "Kiểm tra an toàn, kiểm tra, kiemtrax"


def test_enforcement(spark):
    df = spark.createDataFrame([(1, "hở keo ở mũi", "Glue gaps at toe"), (2, "hở keo", "bond gap here"), (3, "khác", "glue gap"), (4, None, None)], "k long, source string, target string")
    out = {r.k: (r.target, r.replaced) for r in X.enforced(df, "k", [{"term": "hở keo", "target": "bond gap", "synonyms": ["glue gap"]}]).collect()}
    assert out == {1: ("Bond gap at toe", 1), 2: ("bond gap here", 0), 3: ("glue gap", 0), 4: ("", 0)}


def test_queries_without_sql_read_all_lines(spark):
    from termloom import catalog
    from termloom.plans import document_queries, more_queries

    path = "/root/testdata/sf0.001"
    units = catalog.units(spark, path)
    assert document_queries.QUERIES["f24_spelling"](spark, path).count() == units.count()
    plain = units.where(r"NOT text RLIKE '[^\\x00-\\x7F]'")
    assert more_queries.QUERIES["m06_scoped_repair"](spark, path).agg({"units": "sum"}).first()[0] >= plain.count()


def test_queries_without_sql_read_long_and_non_ascii_lines(spark):
    from termloom import catalog
    from termloom.plans import more_queries

    path = "/root/testdata/sf0.001"
    n = catalog.units(spark, path).count()
    total = lambda df, name: df.agg({name: "sum"}).first()[0]
    assert total(more_queries.QUERIES["m01_m02_provider"](spark, path), "n") == n
    assert total(more_queries.QUERIES["m06_scoped_repair"](spark, path), "units") == n

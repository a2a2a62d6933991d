from termloom.operators import inference as I


class Flaky:
    """Fails on batches with a bad text, answers others in upper case; of some it leaves the source in place."""

    def translate(self, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError
        return [t if "same" in t else t.upper() + "!" for t in texts]


def test_call_halves_and_isolates():
    assert I.call(Flaky(), ["a", "bad", "c", "d"]) == ["A!", None, "C!", "D!"]


def test_batches():
    assert list(I.batches_of(["aa", "bb", "c" * 9, "d"], 2, 5)) == [["aa", "bb"], ["c" * 9], ["d"]]


def test_translate_with_fallback(spark):
    rows = [(1, "x"), (2, "x"), (3, "bad y"), (4, "same"), (5, " "), (6, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    offline = I.Offline({"bad y": "worse"}, {"same": "gleich"})
    out = {r.id: (r.target, r.origin) for r in I.translate(df, "text", Flaky(), offline, size=3).collect()}
    assert out == {1: ("X!", "model"), 2: ("X!", "model"), 3: ("Worse", "fallback"), 4: ("Gleich", "fallback"), 5: (None, None), 6: (None, None)}
    out = {r.id: (r.target, r.origin) for r in I.translate(df, "text", Flaky()).collect()}
    assert out[4] == (None, "none") and out[1] == ("X!", "model")


def test_suggestions(spark):
    c = spark.createDataFrame([("Hở keo",), ("lạ",)], "term string")
    t = lambda *rows: spark.createDataFrame(rows, "key string, target string")
    out = {r.term: r.suggestions for r in I.suggestions(c, "term", t(("hở keo", "bond gap"), ("hở keo", "hở")), t(("hở  keo", "glue gap"), ("hở keo", "bond gap")), t(("hở keo", "open glue"), ("hở keo", "z"))).collect()}
    assert out == {"Hở keo": ["bond gap", "glue gap", "open glue"], "lạ": []}
